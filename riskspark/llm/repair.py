"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``. A node of the lattice is (rows consumed, what was read so far:
nothing, the system turn, a user turn, an assistant turn). Edits are its
edges: Keep a row, Rerole it to user or assistant, Delete it, or Insert an
empty user or assistant turn. A forward and a reverse heap meet; when neither
can improve the best crossing any more, all crossings of that cost are
compared and the one with the ASCII-least concatenated audit is taken. A list
of edits fixes the nodes it passes, so of two cheapest audits of one node none
is the start of the other, and the least per node and heap is enough.

Rows: in the order of turn (nulls first), ties by role, then the text's digest.
Equal rows of a turn collapse to one row with a count before they are
shuffled. The first turn with a role and text is found by ``groupBy``; what
comes later is a duplicate.

Skew: the rows are dealt by ranges of (id, turn, role, digest) and sorted, so
a range holds whole conversations or stretches of long ones. A conversation
that ends inside its range is repaired there. Stretches of others are cut to
``PIECE`` rows and become a table of cheapest edits for every pair of (state
before, state after); such tables are joined in order, ``FAN`` at a time,
until one a conversation is left. Its audit is dealt back to the pieces, which
write their repaired lines; only the digest reads a conversation in a row, as
a stream.

Defined results: a null role or text reads as one space; rows of a null id are
one conversation; repeated rows are duplicates; an empty table has no rows;
other columns are dropped. Roles other than the three keep their initial,
which fits only if it is s, u or a.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import table, written

PIECE, FAN, BYTES = 256, 64, 1 << 25
#: States: nothing read, the system turn, a user turn, an assistant turn.
STATES, ENDS = 4, (0, 3)
# Costs of the edits, and the states that a role's initial leads to.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = ("su", "ua", "au")


def _edges(row, q):
    """(state after, cost, audit) of every edit that consumes ``row``: the
    initial, its fault ('' kept, 't' truncated, 'd' must go) and how many
    equal rows must go with it."""
    initial, fault, more = row
    gone, letters = DELETE * more, "D" * more
    yield q, DELETE + gone, "D" + letters
    if fault == "d":
        return
    extra = gone + (TRUNCATED if fault == "t" else 0)
    if (initial, q) in STEP:
        yield STEP[initial, q], extra, "K" + letters
    for role in "ua":
        if (role, q) in STEP and role != initial:
            yield STEP[role, q], REROLE + extra, "R" + letters


def cheapest(rows, starts=(0,), ends=ENDS):
    """(cost, audit, state before, state after) of the cheapest way from one of
    ``starts`` to one of ``ends`` over ``rows``; None if there is none."""
    n = len(rows)
    ahead = {(0, q): (0, "") for q in starts}
    back = {(n, q): (0, "") for q in ends}
    first = {k: k[1] for k in ahead}
    last = {k: k[1] for k in back}
    # rows consumed is the second key: edges that cost nothing consume a row
    fore, rear = [], []
    for q in starts:
        heappush(fore, (0, 0, q))
    for q in ends:
        heappush(rear, (0, 0, q))
    done, far = set(), set()
    best = None
    into = {}
    for (role, q), r in STEP.items():
        into.setdefault(r, []).append((role, q))

    def relax(table, origin, heap, node, cost, audit, source, key):
        old = table.get(node)
        if old is None or (cost, audit) < old:
            table[node], origin[node] = (cost, audit), source
            heappush(heap, (cost, key, node[1]))

    while fore and rear:
        if best is not None and fore[0][0] + rear[0][0] > best:
            break  # strictly: crossings that cost the same are finished first
        if fore[0][0] <= rear[0][0]:
            cost, i, q = heappop(fore)
            if (i, q) in done or ahead[i, q][0] != cost:
                continue
            done.add((i, q))
            audit, source = ahead[i, q][1], first[i, q]
            if i < n:
                for r, price, letters in _edges(rows[i], q):
                    relax(ahead, first, fore, (i + 1, r), cost + price, audit + letters, source, i + 1)
            for role in "ua":
                if (role, q) in STEP:
                    relax(ahead, first, fore, (i, STEP[role, q]), cost + INSERT, audit + "I", source, i)
            if (i, q) in back and (best is None or cost + back[i, q][0] < best):
                best = cost + back[i, q][0]
        else:
            cost, key, q = heappop(rear)
            i = n - key
            if (i, q) in far or back[i, q][0] != cost:
                continue
            far.add((i, q))
            audit, source = back[i, q][1], last[i, q]
            if i:
                for p in range(STATES):
                    for r, price, letters in _edges(rows[i - 1], p):
                        if r == q:
                            relax(back, last, rear, (i - 1, p), cost + price, letters + audit, source, key + 1)
            for role, p in into.get(q, ()):
                if role != "s":
                    relax(back, last, rear, (i, p), cost + INSERT, "I" + audit, source, key)
            if (i, q) in ahead and (best is None or cost + ahead[i, q][0] < best):
                best = cost + ahead[i, q][0]
    # one heap may run dry with the other's labels all in place
    found = [(ahead[k][0] + back[k][0], ahead[k][1] + back[k][1], first[k], last[k]) for k in ahead.keys() & back.keys()]
    return min(found, default=None)


def between(rows):
    """{(state before, state after): (cost, audit)} over ``rows``."""
    out = {}
    for p in range(STATES):
        for q in range(STATES):
            way = cheapest(rows, (p,), (q,))
            if way:
                out[p, q] = way[:2]
    return out


def joined(a, b):
    """The table of two neighbouring stretches; audits are compared whole."""
    out = {}
    for (p, m), (cost, audit) in a.items():
        for (n, q), (more, rest) in b.items():
            if m == n:
                way = cost + more, audit + rest
                if (p, q) not in out or way < out[p, q]:
                    out[p, q] = way
    return out


def lines(audit, roles, texts, copies, emitted, system):
    """The repaired turns of a stretch as ``role:text`` lines; ``emitted``
    turns stand before it, and ``system`` says if the first of all is one."""
    out, i, skip = [], 0, 0
    for edit in audit:
        due = "user" if (emitted + len(out) - system) % 2 == 0 else "assistant"
        if edit == "I":
            out.append(f"{due}:")
            continue
        if skip:  # an equal row that must go
            skip -= 1
            continue
        if edit != "D":
            out.append(f"{roles[i] if edit == 'K' else due}:{texts[i]}")
        skip, i = copies[i] - 1, i + 1
    return out


# What Spark shuffles ------------------------------------------------------

TURN = "id bigint, turn bigint, role string, text string, copies bigint, again boolean, blank boolean, truncated boolean"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: A piece: where it stands, its counts, its ends, its table (for all pairs of
#: states, row by row), and its rows, if the conversation goes on elsewhere.
PIECES = ("id bigint, place bigint, part bigint, whole boolean, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "first string, last string, low bigint, high bigint, turns bigint, costs array<bigint>, audits array<string>, "
          "cost bigint, audit string, sha string, roles array<string>, texts array<string>, copies array<bigint>")


def _rows_of(piece):
    out = []
    for r in piece:
        fault = "d" if r.blank or r.again else "t" if r.truncated else ""
        out.append((r.role[:1], fault, r.copies - 1))
    return out


def _piece(key, place, part, rows, whole, memory):
    """The record of a stretch of rows of one conversation."""
    blank = sum(r.copies for r in rows if r.blank)
    duplicate = sum(r.copies if r.again else r.copies - 1 for r in rows if not r.blank)
    cut = sum(1 for r in rows if r.truncated and not r.blank and not r.again)
    illegal, before = 0, None
    for r in rows:
        initial = r.role[:1]
        illegal += (r.copies - 1) * (2 * initial not in LEGAL)
        illegal += before is not None and before + initial not in LEGAL
        before = initial
    known = [r.turn for r in rows if r.turn is not None]
    out = {"id": key, "place": place, "part": part, "whole": whole, "n": sum(r.copies for r in rows), "blank": blank, "duplicate": duplicate,
           "truncated": cut, "illegal": illegal, "first": rows[0].role[:1], "last": rows[-1].role[:1],
           "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))}
    lattice = tuple(_rows_of(rows))
    roles, texts, copies = [r.role for r in rows], [r.text for r in rows], [r.copies for r in rows]
    if whole:
        if (way := memory.get(lattice)) is None:
            way = cheapest(lattice)[:2]
            if len(lattice) <= 16 and len(memory) < 4096:
                memory[lattice] = way
        cost, audit = way
        said = "\n".join(lines(audit, roles, texts, copies, 0, _shown(audit) % 2))
        out |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()}
    else:
        ways = between(lattice)
        out |= _packed(ways) | {"roles": roles, "texts": texts, "copies": copies}
    return out


def _packed(ways):
    every = [ways.get((p, q)) for p in range(STATES) for q in range(STATES)]
    return {"costs": [None if w is None else w[0] for w in every], "audits": [None if w is None else w[1] for w in every]}


def _unpacked(costs, audits):
    return {(k // STATES, k % STATES): (int(c), a) for k, (c, a) in enumerate(zip(costs, audits)) if a is not None}


def _shown(audit):
    """Turns that the edits leave."""
    return len(audit) - audit.count("D")


FIELDS = [f.split()[0] for f in PIECES.split(", ")]


def _frame(records):
    return pd.DataFrame([[r.get(f) for f in FIELDS] for r in records], columns=FIELDS, dtype=object)


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a sorted range of rows. The range's first and last
    conversation may go on in its neighbours, all others are whole."""
    from pyspark import TaskContext

    part, place, memory, out = TaskContext.get().partitionId(), 0, {}, []
    rows, key, size, opening, cut = [], None, 0, True, False

    def close(ends):
        nonlocal place, size
        whole = not opening and not ends and not cut
        for i in range(0, len(rows), PIECE):
            stretch = rows if whole else rows[i:i + PIECE]
            out.append(_piece(key, place, part, stretch, whole, memory))
            place += 1
            if whole:
                break
        rows.clear()
        size = 0

    started = False
    for batch in batches:
        for c in ("id", "turn"):
            batch[c] = batch[c].astype(object).where(batch[c].notna(), None)
        for r in batch.itertuples(index=False):
            r = r._replace(id=None if r.id is None else int(r.id), turn=None if r.turn is None else int(r.turn))
            if started and r.id != key:
                close(False)
                opening, cut = False, False
            started, key = True, r.id
            rows.append(r)
            size += len(r.text)
            if len(rows) >= 4 * PIECE or size >= BYTES:  # too long for one lattice or record
                cut = True
                close(False)
        if len(out) >= 1000:
            yield _frame(out)
            out.clear()
    if rows:
        close(True)
    yield _frame(out)


JOINED = ("id bigint, place bigint, part bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, "
          "last string, low bigint, high bigint, turns bigint, costs array<bigint>, audits array<string>, sizes array<bigint>")


def join_pieces(key, pieces: pd.DataFrame) -> pd.DataFrame:
    """At most ``FAN`` neighbouring pieces of a conversation as one."""
    pieces = pieces.sort_values(["part", "place"], kind="stable").to_dict("records")
    out = None
    for x in pieces:
        none = lambda v: None if pd.isna(v) else int(v)
        x["low"], x["high"] = none(x["low"]), none(x["high"])
        x["ways"] = _unpacked(x["costs"], x["audits"])
        if out is None:
            out = x | {"sizes": list(x["sizes"])}
            continue
        out["illegal"] += x["illegal"] + (out["last"] + x["first"] not in LEGAL)
        out["turns"] += x["turns"] - (x["low"] is not None and x["low"] == out["high"])
        for c in ("n", "blank", "duplicate", "truncated"):
            out[c] += x[c]
        out["last"] = x["last"]
        if x["high"] is not None:
            out["low"], out["high"] = x["low"] if out["low"] is None else out["low"], x["high"]
        out["sizes"] += list(x["sizes"])
        out["ways"] = joined(out["ways"], x["ways"])
    out |= _packed(out["ways"]) | {"id": None if pd.isna(out["id"]) else int(out["id"])}
    names = [f.split()[0] for f in JOINED.split(", ")]
    return pd.DataFrame([[out[f] for f in names]], columns=names, dtype=object)


def dealt_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest audit of a conversation, cut into those of its pieces: the
    edits of a piece follow its rows, inserts belong to the row before."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            ways = _unpacked(r.costs, r.audits)
            cost, audit = min(ways[0, q] for q in ENDS if (0, q) in ways)
            emitted, at, segments = 0, 0, []
            for k, size in enumerate(r.sizes):
                stop, left = at, int(size)
                while stop < len(audit) and (left or audit[stop] == "I"):
                    left -= audit[stop] != "I"
                    stop += 1
                segments.append((k, audit[at:stop], emitted))
                emitted, at = emitted + _shown(audit[at:stop]), stop
            key = None if pd.isna(r.id) else int(r.id)
            out += [[key, k, cost, audit if k == 0 else None, segment, before, emitted % 2] for k, segment, before in segments]
        yield pd.DataFrame(out, columns=["id", "k", "cost", "audit", "segment", "emitted", "system"], dtype=object)


def written_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"].astype("Int64"), "k": b["k"], "said": [
            lines(*x) for x in zip(b["segment"], b["roles"], b["texts"], b["copies"], b["emitted"], b["system"])]})


def streamed_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sha256 of the newline-joined lines of every conversation, in order."""
    key, h, any_line, started = None, hashlib.sha256(), False, False
    for b in batches:
        out = []
        for k, said in zip(b["id"].astype(object).where(b["id"].notna(), None), b["said"]):
            if started and k != key:
                out.append((key, h.hexdigest()))
                h, any_line = hashlib.sha256(), False
            key, started = k, True
            for line in said:
                h.update((b"\n" if any_line else b"") + line.encode("utf-8", "surrogatepass"))
                any_line = True
        yield pd.DataFrame(out, columns=["id", "sha"], dtype=object)
    if started:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["id", "sha"], dtype=object)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           parts: int | None = None, fan: int = FAN) -> DataFrame:
    """One row a conversation of ``turns``: the faults counted, the gaps in its
    turn numbers, the cheapest edits and the digest of the repaired turns."""
    spark = turns.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).cast("bigint").alias("id"), F.col(turn_col).cast("bigint").alias("turn"),
                        space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    rows = rows.groupBy("id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy(F.col("id").alias("i"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    solid = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    judged = (rows.join(first, same).withColumns({"again": order > F.col("first"), "solid": solid})
              .select("id", "turn", "role", "text", "copies", "again", (F.col("solid") == "").alias("blank"),
                      (~F.col("solid").isin(".", "!", "?")).alias("truncated"), "digest"))
    keys = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = judged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("digest")
    pieces = written(dealt.mapInPandas(stretches, PIECES), "repair")
    whole = pieces.where("whole").select("id", "n", *COUNTS, "low", "high", "turns", "cost", "audit", "sha")
    # stretches of conversations that go on elsewhere
    open_ = pieces.where("not whole")
    level = open_.withColumn("sizes", F.array("n")).select(*[f.split()[0] for f in JOINED.split(", ")])
    level = _numbered(level)
    many = level.agg(F.max("k")).first()[0]
    while many is not None and many > 0:
        level = written(level.withColumn("block", F.floor(F.col("k") / fan)).drop("k").groupBy("id", "block").applyInPandas(join_pieces, JOINED), "join")
        level = _numbered(level)
        many = level.agg(F.max("k")).first()[0]
    back = level.drop("k").mapInPandas(dealt_back, "id bigint, k bigint, cost bigint, audit string, segment string, emitted bigint, system bigint")
    back = written(back, "segments")
    at = _numbered(open_.select("id", "part", "place", "roles", "texts", "copies"))
    said = (at.join(back.withColumnsRenamed({"id": "i", "k": "j"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j")))
            .select("id", "k", "roles", "texts", "copies", "segment", "emitted", "system").mapInPandas(written_lines, "id bigint, k bigint, said array<string>"))
    shas = said.repartition(n, "id").sortWithinPartitions("id", "k").mapInPandas(streamed_digest, "id bigint, sha string")
    long = (level.join(back.where("k = 0").select(F.col("id").alias("i"), "cost", "audit"), F.col("id").eqNullSafe(F.col("i"))).drop("i")
            .join(shas.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i"))).select(whole.columns))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.unionByName(long).select(F.col("id").alias(id_col), gaps.alias("gaps"), *COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"), "n")


def _numbered(pieces: DataFrame) -> DataFrame:
    """``k``: the index of a piece in its conversation. A conversation has a
    piece for every ``PIECE`` rows; they are counted per range first."""
    from pyspark.sql import Window

    slim = pieces.select(F.col("id").alias("__i"), F.col("part").alias("__p"), F.col("place").alias("__q"))
    slim = slim.withColumn("k", F.row_number().over(Window.partitionBy("__i").orderBy("__p", "__q")).cast("bigint") - 1)
    return pieces.join(slim, F.col("id").eqNullSafe(F.col("__i")) & (F.col("part") == F.col("__p")) & (F.col("place") == F.col("__q"))).drop("__i", "__p", "__q")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the faults that the query plants, chosen by a checksum."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = repair(damaged(rows)).drop("n").withColumnRenamed("conv_id", "i")
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    df = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("i")), "left").drop("i")
    return df.fillna({"gaps": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest(), **{c: 0 for c in COUNTS}})


def sql() -> str:
    """DuckDB twin: the lattice row by row. A state's value is its cost in nine
    digits and its audit, so the least string is the cheapest and ASCII-least."""
    add = lambda v, cost, letter: f"(printf('%09d', substr({v}, 1, 9)::INT + {cost}) || substr({v}, 10) || '{letter}')"

    def inserted(q0, q1, q2, q3):
        new2 = f"least({q2}, {add(q0, 3, 'I')}, {add(q1, 3, 'I')}, {add(q3, 3, 'I')})"
        new3 = f"least({q3}, {add(q2, 3, 'I')}, {add(q0, 6, 'II')}, {add(q1, 6, 'II')})"
        return q0, q1, new2, new3

    keep = lambda v, initial, state: f"CASE WHEN fault <> 'd' AND initial = '{initial}' THEN {add(v, 'extra', 'K')} END"
    turn = lambda v: f"CASE WHEN fault <> 'd' THEN {add(v, '3 + extra', 'R')} END"
    rows = ", ".join([
        f"{add('q0', 4, 'D')} AS q0", f"least({add('q1', 4, 'D')}, {keep('q0', 's', 1)}) AS q1",
        "least(" + ", ".join([add("q2", 4, "D"), *[x for q in ("q0", "q1", "q3") for x in (keep(q, "u", 2), turn(q))]]) + ") AS q2",
        f"least({add('q3', 4, 'D')}, {keep('q2', 'a', 3)}, {turn('q2')}) AS q3"])
    i = inserted("q0", "q1", "q2", "q3")
    return rf"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
named AS (SELECT name, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM (SELECT DISTINCT name FROM given), steps),
harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given JOIN named USING (name), (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS initial,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS solid FROM harmed),
judged AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN solid NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ordered),
turns AS (SELECT *, CASE WHEN kind IN ('blank', 'duplicate') THEN 'd' ELSE '' END AS fault, CASE WHEN kind = 'truncated' THEN 3 ELSE 0 END AS extra FROM judged),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS q0, NULL::VARCHAR AS q1, '000000003I' AS q2, '000000006II' AS q3 FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, i, {i[0]}, {i[1]}, {i[2]}, {i[3]} FROM (SELECT t.conv_id, t.i, {rows} FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)),
ends AS (SELECT conv_id, substr(arg_max(least(q0, q3), i), 1, 9)::BIGINT AS cost, substr(arg_max(least(q0, q3), i), 10) AS audit FROM walk GROUP BY conv_id),
edits AS (
  SELECT conv_id, k, e, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i,
    sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS place,
    sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS shown
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS k FROM ends WHERE audit <> '')),
said AS (
  SELECT e.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - shown % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE e <> 'D' GROUP BY e.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(kind = 'blank') AS blank,
    count_if(kind = 'duplicate') AS duplicate, count_if(kind = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = sql()
