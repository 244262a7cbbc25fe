"""Chat formatting in budgeted windows, with DataFrame functions only.

The rows of a conversation stand in the order of their turn (nulls first),
ties by role, then text. Every turn costs its text's tokens and ``OVERHEAD``
for its marks. Prefix sums of these costs choose turn-aligned spans: a span
takes turns while the window stays within the budget, in which the
conversation's opening system turn and the repeated history before the span
are counted. No turn is cut and none is left out; a turn that is longer than
the budget makes a window of its own, marked ``over_budget``.

Skew: the prefix sums come from the library's past-only scan, which splits
conversations of many rows. They deal the turns to blocks of ``BLOCK`` budgets,
each of which starts a new window, so a task holds blocks and never a whole
conversation. Turns that may be history of the next block are copied to it.

Template: ``<s>role\\ntext</s>``, the text of a user between ``[INST] `` and
`` [/INST]``. Control strings inside a role or text get a backslash after
their first character, and those that have backslashes there one more, which
reading back removes again. In a role, ``%`` is ``%25`` and a line feed ``%0A``.

Loss mask: code point spans of the assistants' texts; repeated turns are
context and have none, so each text is a target exactly once.

Defined results: a null role or text is empty; rows of a null id are one
conversation; repeated rows are turns of their own; an empty table has no
windows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import table, written
from riskspark.plans.prior import DEFAULT_CHUNK_ROWS, prior_scan

# The template and its control strings.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROL = r"/?(?:s>|INST\])"
#: Tokens of a turn's marks, and budgets a block.
OVERHEAD, BLOCK = 6, 16
#: A token is at most four characters of a word.
TOKEN = r"[^\x20\x09-\x0D]{1,4}"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({CONTROL})", r"$1$2$3")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _tagged(rows: DataFrame, budget: int, history: int, chunk_rows: int) -> DataFrame:
    """Rows (id, turn, role, text) with their position, cost, the cost of the
    turns before, and their block, as a table in the shared folder."""
    rows = rows.withColumns({
        "n": F.lit(OVERHEAD) + n_tokens("text").cast("bigint"), "known": F.col("turn").isNotNull()})
    rows = prior_scan(rows, "id", ["known", "turn", "role", "text"], value="n", chunk_rows=chunk_rows)
    before = F.coalesce(F.col("_prior_sum"), F.lit(0)).cast("bigint")
    return written(rows.select("id", "role", "text", "n", F.col("_prior_n").cast("bigint").alias("pos"), before.alias("p"),
                               F.floor(before / (BLOCK * budget)).cast("bigint").alias("block")), "chat")


def _blocks(tagged: DataFrame, budget: int, history: int) -> DataFrame:
    """One row a block: its turns in order, before them what may be history."""
    turn = lambda copy: F.struct("p", "pos", "n", "role", "text", F.lit(copy).alias("copy"))
    copies = tagged.where((F.col("n") <= history) & ((F.col("block") + 1) * (BLOCK * budget) - F.col("p") <= history))
    dealt = tagged.select("id", "block", turn(False).alias("t")).unionByName(
        copies.select("id", (F.col("block") + 1).alias("block"), turn(True).alias("t")))
    grouped = dealt.groupBy("id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count_if(F.col("t.copy")).alias("c"))
    return grouped.where(F.size("t") > F.col("c"))  # a block of copies only has no turns


def _spans(budget: int, history: int) -> Column:
    """Where the windows of a block start: indexes into its own turns."""
    own = F.transform(F.filter("t", lambda x: ~x["copy"]), lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"), x["pos"].alias("pos")))
    later = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.n"), F.lit(0)), F.lit(budget // 4))

    def step(acc, x):
        limit = F.when(acc["opening"], F.lit(budget)).otherwise(later)
        fits = (F.size(acc["starts"]) > 0) & (acc["used"] + x["n"] <= limit)
        return F.struct(
            F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], x["i"])).alias("starts"),
            F.when(fits, acc["used"] + x["n"]).otherwise(x["n"]).alias("used"),
            F.when(fits, acc["opening"]).otherwise(x["pos"] == 0).alias("opening"))

    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("opening"))
    return F.aggregate(own, start, step, lambda acc: acc["starts"])


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """One row a window: the id, ``first`` (position of its first own turn),
    ``n_context`` (repeated turns before it), ``n_turns`` (its own),
    ``n_tokens``, ``over_budget``, ``formatted``, and ``mask``, an array of
    (start, stop) in code points of ``formatted``."""
    assert 0 <= history < budget
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    tagged = _tagged(rows, budget, history, chunk_rows)
    blocks = _blocks(tagged, budget, history)
    opening = blocks.where("block = 0").withColumn(
        "system", F.when(F.col("t")[0]["role"] == "system", F.struct(F.col("t")[0]["n"].alias("n"), F.col("t")[0]["text"].alias("text"))))
    systems = tagged.where("pos = 0 and role = 'system'").select(F.col("id").alias("of"), F.struct("n", "text").alias("system"))
    later = blocks.where("block > 0").join(systems, F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    df = opening.unionByName(later).withColumn("starts", _spans(budget, history))
    # one row a window: its own turns and the history before them
    df = df.select("id", "system", "t", "c", "starts", F.posexplode("starts").alias("w", "start"))
    df = df.withColumns({
        "at": F.col("c") + F.col("start"),
        "stop": F.when(F.col("w") + 1 < F.size("starts"), F.col("c") + F.get("starts", F.col("w") + 1)).otherwise(F.size("t"))})
    own = F.slice("t", (F.col("at") + 1).cast("int"), (F.col("stop") - F.col("at")).cast("int"))
    begin = F.get("t", F.col("at").cast("int"))["p"]
    retained = F.col("system").isNotNull() & (F.get("t", F.col("at").cast("int"))["pos"] > 0)
    past = F.filter(F.slice("t", F.lit(1), F.col("at").cast("int")),
                    lambda x: (begin - x["p"] <= history) & ~(F.col("system").isNotNull() & (x["pos"] == 0)))
    shown = lambda many, old: F.transform(many, lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("text"), x["n"].alias("n"), F.lit(old).alias("old")))
    system = F.when(retained, F.array(F.struct(F.lit("system").alias("role"), F.col("system.text").alias("text"), F.col("system.n").alias("n"), F.lit(True).alias("old")))
                    ).otherwise(F.array().cast("array<struct<role:string,text:string,n:bigint,old:boolean>>"))
    df = df.select("id", begin.alias("p"), F.get("t", F.col("at").cast("int"))["pos"].alias("first"),
                   F.concat(system, shown(past, True), shown(own, False)).alias("turns"))
    ask = lambda x, mark: F.when(x["role"] == "user", F.lit(mark)).otherwise(F.lit(""))
    df = df.withColumn("parts", F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), _role(x["role"]), F.lit("\n"), ask(x, ASK)).alias("head"), escaped(x["text"]).alias("body"),
        F.concat(ask(x, ASKED), F.lit(CLOSE)).alias("tail"), (~x["old"] & (x["role"] == "assistant")).alias("target"))))
    df = df.withColumn("sizes", F.transform("parts", lambda x: F.struct(
        F.char_length(x["head"]).cast("bigint").alias("head"), F.char_length(x["body"]).cast("bigint").alias("body"),
        F.char_length(x["tail"]).cast("bigint").alias("tail"), x["target"].alias("target"))))
    span = "array<struct<start:bigint,stop:bigint>>"

    def masked(acc, x):
        start = acc["at"] + x["head"]
        return F.struct((start + x["body"] + x["tail"]).alias("at"), F.when(x["target"], F.array_append(acc["spans"], F.struct(
            start.alias("start"), (start + x["body"]).alias("stop")))).otherwise(acc["spans"]).alias("spans"))

    total = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return df.select(
        F.col("id").alias(id_col), "first", F.size(F.filter("turns", lambda x: x["old"])).alias("n_context"),
        F.size(F.filter("turns", lambda x: ~x["old"])).alias("n_turns"), total.alias("n_tokens"), (total > budget).alias("over_budget"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.aggregate("sizes", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("spans")), masked,
                    lambda acc: acc["spans"]).alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """Add ``turns`` (role and text of the window's own turns, parsed from
    ``formatted``) and ``targets`` (the texts under the mask), both unescaped."""
    marked = F.slice(F.split("formatted", CLOSE), F.col("n_context") + 1, F.col("n_turns"))

    def parsed(x):
        line = F.instr(x, "\n")
        role = _role_back(F.substring(x, F.lit(len(OPEN) + 1), line - len(OPEN) - 1))
        body = F.substring(x, line + 1, F.char_length(x))
        asked = F.substring(body, F.lit(len(ASK) + 1), F.char_length(body) - len(ASK) - len(ASKED))
        return F.struct(role.alias("role"), unescaped(F.when(role == "user", asked).otherwise(body)).alias("text"))

    return windows.withColumns({
        "turns": F.transform(marked, parsed),
        "targets": F.transform("mask", lambda x: unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int"))))})


def digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation what its windows say. The two digests are of the whole
    conversation, so its text passes through one row here, and only here."""
    said = read_back(windows).select(
        id_col, F.struct("first", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
                         F.array_join("targets", "").alias("loss")).alias("w"),
        F.col("n_turns").cast("bigint").alias("n_turns"), F.char_length("formatted").cast("bigint").alias("n"))
    df = said.groupBy(id_col).agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"),
                                  F.sum("n").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    whole = lambda part: F.array_join(F.transform("w", lambda x: x[part]), "")
    df = df.withColumns({"said": whole("said"), "loss": whole("loss")})
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return df.select(id_col, "n_turns", digest("said").alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
                     digest("loss").alias("loss_sha256"), "formatted_chars", "n_windows")


# The conversation that the query adds.
ADDED = "</s>[INST] ok [/INST]"


def op12_chat_windows(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return digests(format_windows(rows.unionByName(more)))


def sql(budget: int = 1024, history: int = 256) -> str:
    """DuckDB twin: spans by recursion over the positions of a conversation."""
    esc = r"regexp_replace({}, '([<\[])(\\*)(" + CONTROL + r")', '\1\2\\\3', 'g')"
    role = esc.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}'),
priced AS (
  SELECT *, {OVERHEAD} + len(regexp_extract_all(text, '{TOKEN}')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM given),
placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p,
    {len(OPEN) + 1 + len(CLOSE)} + length({role}) + length({esc.format('text')}) + CASE WHEN role = 'user' THEN {len(ASK) + len(ASKED)} ELSE 0 END AS size
  FROM priced),
opened AS (SELECT conv_id, n, size FROM placed WHERE pos = 0 AND role = 'system'),
turns AS (
  SELECT t.*, t.p // {BLOCK * budget} AS block, o.n AS system_n, o.size AS system_size,
    greatest({budget - history} - coalesce(o.n, 0), {budget // 4}) AS later
  FROM placed t LEFT JOIN opened o ON t.conv_id IS NOT DISTINCT FROM o.conv_id),
walk AS (
  SELECT conv_id, pos, block, 0::BIGINT AS first, n AS used FROM turns WHERE pos = 0
  UNION ALL
  SELECT t.conv_id, t.pos, t.block, CASE WHEN go THEN first ELSE t.pos END, CASE WHEN go THEN used + t.n ELSE t.n END
  FROM (SELECT t.*, w.first, w.used, w.block = t.block AND w.used + t.n <= CASE WHEN w.first = 0 THEN {budget} ELSE t.later END AS go
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1) t),
windows AS (SELECT DISTINCT w.conv_id, w.first, t.p, t.system_size FROM walk w JOIN turns t
            ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.first),
repeated AS (
  SELECT w.conv_id, w.first, coalesce(sum(t.size), 0) + CASE WHEN w.first > 0 THEN coalesce(max(w.system_size), 0) ELSE 0 END AS size
  FROM windows w LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos < w.first AND w.p - t.p <= {history}
    AND NOT (t.pos = 0 AND t.system_n IS NOT NULL)
  GROUP BY w.conv_id, w.first),
context AS (SELECT conv_id, sum(size) AS size, count(*) AS n_windows FROM repeated GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(size) AS size
  FROM turns GROUP BY conv_id)
SELECT s.conv_id, s.n_turns::BIGINT AS n_turns, s.turns_sha256, length(s.loss)::BIGINT AS loss_chars, sha256(s.loss) AS loss_sha256,
  (s.size + c.size)::BIGINT AS formatted_chars, c.n_windows::BIGINT AS n_windows
FROM said s JOIN context c ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_SQL = sql()
