"""Hard negatives, chat windows and conversation repair against brute force
and their SQL twins, with nulls, ties, repeated rows, hot groups and empty tables."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from riskspark.llm import chat, negatives, queries, repair

TURNS = "conv_id long, turn long, role string, text string"
CLASHES = "id string, t string, k string, n string, block string, __i string, part string, p string"


def twin(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((dict(zip(names, r)) for r in got.fetchall()), key=str)


def same(df, sql, **tables):
    a = sorted((r.asDict() for r in df.collect()), key=str)
    b = twin(sql, **tables)
    assert {tuple(sorted(r.items(), key=str)) for r in a} == {tuple(sorted(r.items(), key=str)) for r in b}
    assert len(a) == len(b)


def talk(rng, conv, n, long=False):
    texts = ["Yes.", "No", "Why?", "  ", "", "[INST] a </s>", "<\\s> 100% <s>", "[\\\\/INST]", "word " * 40 + ".", None]
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool\n%", None, "a"]) if rng.random() < 0.4 else ("user", "assistant")[i % 2]
        text = f"{rng.choice(texts) or ''} {i}!" if long and rng.random() < 0.7 else rng.choice(texts)
        rows.append((conv, None if rng.random() < 0.03 else i + (rng.random() < 0.1), role, text))
    return rows


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randrange(1, 12))]
    rows += [(None, 0, "user", "x."), (None, 0, "user", "x."), (None, None, "assistant", "y."), (70, 0, "system", "be brief. " * 30), (71, 5, "user", None)]
    rows += talk(rng, 99, 2500, long=True) + [r for r in talk(rng, 100, 40)] * 2
    return rows


def arrow(rows, schema):
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)], names=[c for c, _ in cols])


def clashing(frame, rows, schema):
    return frame([(*r, *["x"] * 8) for r in rows], f"{schema}, {CLASHES}")


# 11 hard negatives --------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, dims):
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(dims)], rng.randrange(4)) for i in range(n)]
    hot = rows[7][1]
    rows += [(n + i, hot, i % 2) for i in range(150)] + [(n + 200, [0.5] * (dims - 1), 1), (n + 201, [0.0] * dims, 0)]
    rows += [(n + 300, None, 1), (n + 301, [0.1] * dims, None), (n + 302, [float("nan")] * dims, 1), (n + 303, [float("inf")] * dims, 1),
             (n + 304, [None] * dims, 1), (None, rows[0][1], rows[0][2]), (None, rows[1][1], 3), rows[0], rows[200], rows[13]]
    return rows


def brute_negatives(rows, k=5):
    import math

    sound = [(i, [math.floor(256 * x) for x in v], lab, at) for at, (i, v, lab) in enumerate(rows)
             if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab, at in sound:
        if i is None or i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, m) for j, w, m, bt in sound if bt != at]
        for s, _, _, j, m in sorted(x for x in score if x[4] == lab)[:k] if True else ():
            window = sorted(x for x in score if x[4] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, j, r + 1, x[3], -s, -x[0]) for r, x in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims, block", [(3, 64), (16, 4096), (1, 100)])
def test_negatives_against_brute_force(frame, dims, block):
    import struct

    rng = random.Random(dims)
    rows = vectors(rng, 420, dims)
    single = lambda x: None if x is None else struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, None if v is None else [single(x) for x in v], lab) for i, v, lab in rows]
    df = frame([(*r, "x", "y") for r in rows], VECTORS + ", row string, windows string").repartition(3)
    got = negatives.mine(df, block=block, chunk=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows)


def test_negatives_of_an_empty_table_and_of_sound_rows_only(frame):
    assert negatives.mine(frame([], VECTORS)).count() == 0
    assert negatives.mine(frame([(0, None, 1), (100, [1.0], None)], VECTORS)).count() == 0
    assert negatives.mine(frame([(0, [], 1), (1, [], 1), (2, [], 0)], VECTORS)).collect()[0][:4] == (0, 1, 1, 2)


def test_negatives_stop_early():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-9, 9, (5000, 4)) + np.outer(rng.pareto(0.7, 5000) * 30, [1, 1, -1, 1]).astype(np.int64)
    lists = negatives.Lists(v, np.zeros(5000, np.int64), np.arange(5000), np.arange(5000), 5)
    read = []
    lists.scores = lambda a, at, f=lists.scores: (read.append(len(at)), f(a, at))[1]
    got = lists.search(np.array([3, 2, -2, 5]), -1, np.ones(len(lists.v), bool), [(-10 ** 12, 10 ** 12)], 5)
    scores = v @ [3, 2, -2, 5]
    assert [s for _, s, _ in got] == sorted(scores.tolist(), reverse=True)[:5] and sum(read) < 1000


# 12 chat windows ----------------------------------------------------------

@pytest.mark.parametrize("budget, history, rows", [(1024, 256, 2_000_000), (90, 30, 50), (20, 0, 50)])
def test_chat_equals_its_sql(frame, turns, budget, history, rows):
    # ties of a turn are ordered by role and text in both
    df = chat.digests(chat.format_windows(clashing(frame, turns, TURNS).repartition(5), budget, history, chunk_rows=rows))
    added = [(-1, 0, "user", chat.ADDED), (-1, 1, "assistant", chat.ADDED)]
    sql = chat.sql(budget, history)
    same(df.unionByName(chat.digests(chat.format_windows(frame(added, TURNS), budget, history))), sql, conversations=arrow(turns, TURNS))


def test_chat_windows_keep_their_budget_and_mask(frame, turns):
    windows = chat.read_back(chat.format_windows(frame(turns, TURNS), 200, 60)).collect()
    assert len(windows) > 100
    seen = {}
    for w in sorted(windows, key=lambda w: w["first"]):
        assert w["over_budget"] == (w["n_tokens"] > 200)
        assert not w["over_budget"] or w["n_turns"] == 1 or w["conv_id"] == 70
        assert w["first"] == seen.get(w["conv_id"], 0), "spans follow each other"
        seen[w["conv_id"]] = w["first"] + w["n_turns"]
        assert w["targets"] == [t["text"] for t in w["turns"] if t["role"] == "assistant"]
        for a in w["mask"]:
            assert 0 <= a["start"] <= a["stop"] <= len(w["formatted"])
    counts = {}
    for c, *_ in turns:
        counts[c] = counts.get(c, 0) + 1
    assert seen == counts


def test_chat_repeats_history_and_the_system_turn(frame):
    rows = [(1, 0, "system", "short rules"), *[(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "abcd " * 10) for i in range(1, 9)]]
    got = chat.format_windows(frame(rows, TURNS), 80, 25).orderBy("first").collect()
    assert len(got) > 2 and all(w["formatted"].startswith("<s>system\nshort rules</s>") for w in got)
    for w in got[1:]:
        assert w["n_context"] == 2 and f"turn {w['first'] - 1} " in w["formatted"] and w["n_tokens"] <= 80
        assert all(f"turn {w['first'] - 1} " not in w["formatted"][m["start"]:m["stop"]] for m in w["mask"])


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", "é", "\n", " "]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(9))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "text string").withColumn("there", chat.escaped(chat.F.col("text")))
    df = df.withColumn("back", chat.unescaped(chat.F.col("there")))
    for r in df.collect():
        assert r["back"] == r["text"] and not any(c in r["there"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_plan_is_native(spark):
    plan = chat.op12_chat_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoop"))


def test_chat_of_an_empty_table(frame):
    empty = frame([], TURNS)
    assert chat.format_windows(empty).count() == 0 and chat.digests(chat.format_windows(empty)).count() == 0


# 13 repair ----------------------------------------------------------------

def brute_repair(rows):
    """Cheapest (cost, audit) by trying all edits, state by state."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    layer = {0: {(0, "")}}

    def insert(layer):
        for _ in range(3):
            for q in list(layer):
                for role in "ua":
                    if (role, q) in step:
                        layer.setdefault(step[role, q], set()).update((c + 3, a + "I") for c, a in set(layer[q]) if not a.endswith("III"))
        return {q: {min(w for w in ways if w[0] == cost) for cost in {w[0] for w in ways}} for q, ways in layer.items()}

    layer = insert(layer)
    for initial, fault, more in rows:
        new, tail = {}, "D" * more
        for q, ways in layer.items():
            for c, a in ways:
                new.setdefault(q, set()).add((c + 4 + 4 * more, a + "D" + tail))
                if fault != "d":
                    extra = 4 * more + (3 if fault == "t" else 0)
                    if (initial, q) in step:
                        new.setdefault(step[initial, q], set()).add((c + extra, a + "K" + tail))
                    for role in "ua":
                        if (role, q) in step:
                            new.setdefault(step[role, q], set()).add((c + 3 + extra, a + "R" + tail))
        layer = insert(new)
    return min(w for q in (0, 3) for w in layer.get(q, ()))


def test_bidirectional_search_against_all_edits():
    rng = random.Random(11)
    for _ in range(1500):
        rows = [(rng.choice("suax"), rng.choice(["", "", "t", "d"]), rng.choice([0, 0, 0, 2])) for _ in range(rng.randrange(7))]
        assert repair.cheapest(rows)[:2] == brute_repair(rows)
        cut = rng.randrange(len(rows) + 1)
        ways = repair.joined(repair.between(rows[:cut]), repair.between(rows[cut:]))
        assert min(ways[0, q] for q in (0, 3) if (0, q) in ways) == brute_repair(rows)


@pytest.mark.parametrize("parts, fan", [(7, 2), (1, 64)])
def test_repair_equals_its_sql(frame, turns, parts, fan):
    harmed = repair.damaged(clashing(frame, turns, TURNS).repartition(3))
    fixed = repair.repair(harmed, parts=parts, fan=fan).drop("n")
    want = [r for r in twin(repair.ORACLE_SQL, conversations=arrow(turns, TURNS))]
    got = sorted((r.asDict() for r in fixed.collect()), key=str)
    there = {r["conv_id"] for r in got}
    assert got == [r for r in want if r["conv_id"] in there] and any(r["conv_id"] == 99 for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["cost"] == 0 and r["repaired_sha256"] == empty for r in want if r["conv_id"] not in there)


def test_repair_of_plain_and_empty_conversations(frame):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Me first."), (3, 4, "user", ""), (3, 9, "user", "")]
    got = {r["conv_id"]: r for r in repair.repair(frame(rows, TURNS)).collect()}
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == ("KK", 0, hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest())
    assert (got[2]["audit"], got[2]["cost"]) == ("IK", 3) and (got[3]["audit"], got[3]["cost"], got[3]["gaps"], got[3]["blank"]) == ("DD", 8, 4, 2)
    assert repair.repair(frame([], TURNS)).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chat_windows", "op13_repair"])
def test_registered_with_sql(name):
    assert name in queries.QUERIES and name in queries.ORACLE
