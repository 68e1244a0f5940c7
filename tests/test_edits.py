"""Edits against naive loops on random files."""

import random
import re

from sparkwright.operators import edits as E

EDIT = "file string, start long, end long, text string, rank long, priority long, ordinal long"
OPERATION = "file string, op string, line long, end_line long, to_line long, word string, text string, priority long, ordinal long"


def collide(a, b):
    (s, e), (t, f) = a, b
    if s == e or t == f:
        return (s != e or t != f) and (t < s < f if s == e else s < t < e)
    return s < f and t < e


def greedy(rows):
    proposals = {}
    for r in set(rows):
        proposals.setdefault(r[5:], []).append(r)
    taken = []
    for key in sorted(proposals):
        mine = proposals[key]
        inner = any(a[0] == b[0] and collide(a[1:3], b[1:3]) for i, a in enumerate(mine) for b in mine[:i])
        if not inner and not any(a[0] == b[0] and collide(a[1:3], b[1:3]) for a in mine for b in taken):
            taken += mine
    return sorted(taken)


def test_proposals_equal_a_greedy_loop(spark):
    rnd = random.Random(4)
    rows = []
    for ordinal in range(260):
        for _ in range(rnd.choice([1, 1, 1, 2, 3])):
            start = rnd.randint(0, 60)
            rows.append((rnd.choice("abc"), start, start + rnd.choice([0, 0, 1, 2, 5, 20]), "x", 0, rnd.randint(0, 3), ordinal))
    rows += [("d", k, k + 2, "", 0, 1, 1000 + k) for k in range(12)] + [("e", 0, 10**9, "", 0, 9, 5000), ("e", 5, 5, "", 0, 9, 5001)] + rows[:5]
    got = sorted(tuple(r) for r in E.together(spark.createDataFrame(rows, EDIT)).collect())
    assert got == greedy(rows) and 40 < len(got) < len(rows) / 2
    assert E.together(spark.createDataFrame([], EDIT)).count() == 0


def naive_lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def naive_edits(files, operations):
    """The same lowering by plain loops over lists of lines."""
    out = []
    ended = lambda t: t if t.endswith("\n") else t + "\n"
    for file, op, line, end_line, to_line, word, text, priority, ordinal in operations:
        body = naive_lines(files[file])
        at = [0]
        for b in body:
            at.append(at[-1] + len(b))
        put = lambda s, e, t, rank=0: out.append((file, s, e, t, rank, priority, ordinal))  # noqa: E731, B023
        target = at[to_line - 1] if to_line is not None and 1 <= to_line <= len(body) + 1 and body else None
        if op == "rename":
            pos = 0
            for token in re.findall(r"\w+|\W+", files[file]):
                if token == word and word != text:
                    put(pos, pos + len(token), text)
                pos += len(token)
        elif op == "add":
            if target is not None:
                put(target, target, ended(text))
        elif 1 <= line <= end_line <= len(body):
            s, e = at[line - 1], at[end_line]
            if op == "remove":
                k = end_line
                while k < len(body) and not body[k].strip():
                    k += 1
                put(s, at[k] if k > end_line and (line == 1 or not body[line - 2].strip()) else e, "")
            elif op == "replace":
                put(s, e, ended(text))
            elif op == "move" and target is not None and (target < s or target > e):
                put(s, e, "")
                put(target, target, ended("".join(body[line - 1 : end_line])), s)
            elif op == "reorder":
                old = [ended(b) for b in body[line - 1 : end_line]]
                new = sorted(old)
                changed = [i for i in range(len(old)) if old[i] != new[i]]
                if changed:
                    put(at[line - 1 + changed[0]], at[line + changed[-1]], "".join(new[changed[0] : changed[-1] + 1]))
    return out


def naive_apply(text, rows):
    for r in sorted(rows, key=lambda r: (r[1], r[2], *r[4:]), reverse=True):
        text = text[: r[1]] + r[3] + text[r[2] :]
    return text


def test_operations_equal_plain_loops(spark):
    rnd = random.Random(8)
    files = {f"f{i}": "".join(rnd.choice(["a b\n", "b\n", "\n", "  \n", "é_x a\n", "c-a\n"]) for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", "end a"]) for i in range(25)}
    files["none"] = ""
    operations = []
    for i in range(220):
        file = rnd.choice(sorted(files))
        line = rnd.randint(1, 12)
        operations.append((file, rnd.choice(["remove", "add", "replace", "move", "rename", "reorder"]), line, line + rnd.randint(0, 3), rnd.randint(1, 13), rnd.choice(["a", "b", "é_x"]), rnd.choice(["new", "two\nlines", "a"]), rnd.randint(0, 2), i))
    table = spark.createDataFrame(list(files.items()), "file string, text string")
    found = E.lowered(spark.createDataFrame(operations, OPERATION), table).cache()
    got, want = sorted(tuple(r) for r in found.collect()), sorted(naive_edits(files, operations))
    assert got == want and len({r[-1] for r in got}) > 60
    stand = E.together(found).cache()
    chosen = sorted(tuple(r) for r in stand.collect())
    assert chosen == greedy(want)
    after = {r.file: r.text for r in E.applied(table, stand).collect()}
    assert after == {f: naive_apply(t, [r for r in chosen if r[0] == f]) for f, t in files.items()} and after != files


def test_edits_of_one_island_need_no_round(spark, monkeypatch):
    def no_round(_):
        raise AssertionError("a chain of collisions went by rounds")

    monkeypatch.setattr(E, "_beaten_by_rounds", no_round)
    # each collides with the next, and the last comes first
    rows = [("a", 2 * k, 2 * k + 3, "", 0, 1, 1000 - k) for k in range(200)] + [("b", 4, 4, "", 0, 1, 1), ("b", 3, 5, "", 0, 2, 2), ("b", 4, 9, "", 0, 3, 3)]
    got = sorted(tuple(r) for r in E.together(spark.createDataFrame(rows, EDIT)).collect())
    assert got == greedy(rows) and len(got) == 102


def test_large_islands_go_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(E, "LARGE", 3)
    rows = [("a", k, k + 2, "", 0, 1, k * 7 % 11) for k in range(11)] + [("b", 5, 9, "", 0, 1, 20), ("b", 6, 7, "", 0, 1, 21)]
    assert sorted(tuple(r) for r in E.together(spark.createDataFrame(rows, EDIT)).collect()) == greedy(rows)


def test_lines_and_words_stay_where_their_text_is(spark):
    files = spark.createDataFrame([("f", "a b\na\n")], "file string, text string")
    assert "Exchange" not in E.lines(files)._jdf.queryExecution().executedPlan().toString()
