"""Every registered query of the library proper against its SQL over the smallest tables, and the entry points' guard."""

import os
import subprocess
import sys

import duckdb
import pytest

from sparkwright.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(repr, ([plain(r[c]) for c in columns] for r in df.collect())))
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(map(repr, ([plain(row[names.index(c)]) for c in columns] for row in found.fetchall())))


def test_entry_works_without_the_optional_parts(tmp_path):
    """The entry module imports, and its other queries stay, where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("__spark_entry__.py", "sparkwright"):
        os.symlink(os.path.join(root, part), tmp_path / part)
    code = "import sys, __spark_entry__ as e; sys.modules['sparkwright.llm'] = None; q = e.queries(); assert 'decision_max_lines' in q and not any(n.startswith('op') for n in q); assert 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
