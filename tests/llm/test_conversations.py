import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from sparkwright.llm import conversations, queries

SMALL = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, chain string, n int, key string"


def brute(rows):
    """(conv_id, depth, parent's conv_id, members, children, leaves, saved, digest) of every node, by plain dictionaries."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (*t[:3], sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()[:16])
    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c % 100 if c >= 0 else -(-c % 100)
        full[c] = (*own.get(c - rest, [])[:h], *turns[h:])
    members, children = {}, {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    ends = lambda node: sha256(",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node)))).encode()).hexdigest()
    return sorted(
        (min(m), len(v), min(members[v[:-1]]) if v else -(10**9), len(m), len(children.get(v, ())), leaves[v], saved[v], ends(v)) for v, m in members.items()
    )


def plain(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-(10**9) if r[n] is None else r[n] for n in names) for r in df.select(names).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND)


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert plain(queries.op11_conversations(spark, SMALL)) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    found = duck.execute(f"SELECT conv_id, depth, coalesce(parent_conv_id, -1000000000), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.oracle_sql()['op11_conversations']})").fetchall()
    assert sorted(found) == want


@pytest.mark.parametrize("runs", [{}, {"run_rows": 1}, {"run_rows": 3, "run_turns": 7}])
def test_random_conversations_by_runs_of_any_size(spark, runs):
    """Few different turns, so that prefixes meet; null turns, roles and texts, ties, copies, ids missing, negative and far."""
    rnd = random.Random(11)
    rows = []
    for c in [*range(0, 330), 1000, 1001, 10**12, 10**12 + 7, -1, -250, 5105]:
        if c % 7 == 3:
            continue
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "user", None]), rnd.choice(["é", "bb", "", None])))
    rows += [(c, t, "user", "same") for c in range(2000, 2100) for t in range(4)]
    rows += [(None, 1, "user", "belongs to nobody")]
    rnd.shuffle(rows)
    assert plain(conversations.rebuilt_trie(table(spark, rows).repartition(5), **runs)) == brute(rows)


def test_long_hot_and_empty(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(3000)] + [(8, t, "user", f"t{t}") for t in range(2990)] + [(c, 0, "user", "hi") for c in range(100, 9000)]
    rows += [(9050, 0, None, None)]
    assert plain(conversations.rebuilt_trie(table(spark, rows), run_rows=200)) == brute(rows)
    assert conversations.rebuilt_trie(table(spark, [])).count() == 0
    assert conversations.rebuilt_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
