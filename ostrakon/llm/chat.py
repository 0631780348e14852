"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``<turn role>text</turn>`` and a line feed.  In roles and
texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes
``\\g``; so no control string survives inside a text, and reading back is
exact.

Prefix sums of turn tokens choose the spans.  The room of a window is its
budget less the system turn and the allowance for history.  A span takes turns
as long as its prefix sums stay within the room, and always one; counting
starts anew with every ``BLOCK`` turns, so the work of a turn is bounded
however long its conversation.  So spans are turn-aligned, and exceed the room
only where a single turn does.  Each window holds the system turn, its span,
and at most ``history_turns`` earlier turns of at most ``history_tokens``
tokens, fewer where the span leaves less; so no window exceeds the budget
unless the system turn and one turn do.  The loss mask covers the assistant
texts of the span; repeated turns are masked, so each target counts once.

Defined cases: null roles and texts count as empty; turns are ordered by turn,
role, text (null turns first), so ties and repeated rows keep a place each; a
null conv_id is one conversation; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_OVERHEAD = 512, 2, 128, 4
#: Turns after which spans start anew.
BLOCK = 64
#: A token: a run of ASCII letters, digits and underscores, or any other character that is not white space.
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x09-\x0D\x20]"
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    """Exact, as each backslash starts an escape and the backslash's own comes last."""
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def spans(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, i, role, text, window, and the later windows that repeat the turn."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + TURN_OVERHEAD)
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(along) - 1)
    rows = rows.withColumn("system", (F.col("i") == 0) & (F.col("role") == "system"))
    rows = rows.withColumn("kept", F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far))
    rows = rows.withColumn("end", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(so_far))
    rows = rows.withColumn("start", F.when(F.col("system"), F.col("end")).otherwise(F.col("end") - F.col("tokens")))
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("kept"))
    rows = rows.withColumn("room", room).withColumn("block", F.floor(F.col("i") / BLOCK))
    sums = F.collect_list(F.struct("start", "end", "room")).over(Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))

    def step(state: Column, turn: Column) -> Column:
        # The system turn, which adds nothing to the sums, stands with whatever span is first.
        over = (turn["end"] - state["start"] > turn["room"]) & (turn["start"] > state["start"])
        return F.struct(F.when(over, turn["start"]).otherwise(state["start"]).alias("start"), (state["span"] + over.cast("int")).alias("span"))

    rows = rows.withColumn("sums", sums).withColumn("span", F.aggregate("sums", F.struct(F.get("sums", F.lit(0))["start"].alias("start"), F.lit(0).alias("span")), step)["span"]).drop("sums")
    rows = rows.withColumn("fresh", F.coalesce((F.lag("span").over(along) != F.col("span")) | (F.lag("block").over(along) != F.col("block")), F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("fresh").cast("int")).over(so_far))
    own = F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv_id", "window"))
    rows = rows.withColumn("left", F.least(F.lit(history_tokens), budget - F.col("kept") - own))
    repeats = [
        F.when(~F.col("system") & F.lead("fresh", k).over(along) & (F.lead("start", k).over(along) - F.col("start") <= F.lead("left", k).over(along)), F.lead("window", k).over(along))
        for k in range(1, history_turns + 1)
    ]
    rows = rows.withColumn("later", F.array_compact(F.array(*repeats)) if repeats else F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", F.max("window").over(Window.partitionBy("conv_id")))
    again = F.when(F.col("system") & (F.col("windows") > 1), F.sequence(F.lit(2).cast("long"), F.col("windows"))).otherwise(F.col("later"))
    return rows.select("conv_id", "i", "role", "text", "tokens", "window", again.alias("repeated_in"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window, text, n_repeated, tokens, loss (start and length of each unmasked stretch, in code points)."""
    placed = spans(conversations, budget, history_turns, history_tokens)
    own = F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("r")))
    more = F.transform("repeated_in", lambda w: F.struct(w.alias("w"), F.lit(True).alias("r")))
    placed = placed.withColumn("place", F.explode(F.concat(own, more)))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    piece = F.struct(F.col("i"), F.col("place.r").alias("repeated"), (F.col("role") == "assistant").alias("target"), F.length(head).alias("head"), escaped(F.col("text")).alias("body"), F.concat(head, escaped(F.col("text")), F.lit(END)).alias("whole"), F.col("tokens"))
    grouped = placed.groupBy("conv_id", F.col("place.w").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("turns"))

    def step(state: Column, turn: Column) -> Column:
        found = F.when(turn["target"] & ~turn["repeated"], F.array(F.struct((state["at"] + turn["head"]).alias("start"), F.length(turn["body"]).alias("length"))))
        return F.struct((state["at"] + F.length(turn["whole"])).alias("at"), F.concat(state["loss"], F.coalesce(found, F.array().cast("array<struct<start:int,length:int>>"))).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("text"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0), lambda s, t: s + t["tokens"]).alias("tokens"),
        F.aggregate("turns", zero, step)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text; the repeated ones left out), loss texts, formatted_chars: all from the formatted text and its mask."""
    pieces = F.split("text", END)
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("n_repeated")))
    return windows.select(
        "conv_id", "window",
        F.transform(fresh, lambda p: F.struct(unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"), unescaped(F.substr(p, F.instr(p, F.lit(CLOSE)) + 1)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"]))).alias("loss"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """A row for each conversation: what its windows say, read back."""
    joined = read_back(windows).select(
        "conv_id", "window", "formatted_chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss", "").alias("loss"),
    )
    one = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    turns, loss = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    return one.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def with_trap(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold control strings."""
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(trap)


_ESC = "replace(replace(replace({0}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '>', chr(92) || 'g')"
#: The rows of ``digests`` over ``with_trap`` in SQL.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\x09-\\x0D\\x20]')) + {TURN_OVERHEAD} AS tokens FROM t
), b AS (
  SELECT *, (i = 0 AND role = 'system') AS sys,
    sum(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS kept,
    sum(CASE WHEN i = 0 AND role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY i) AS e FROM a
), c AS (
  SELECT *, CASE WHEN sys THEN e ELSE e - tokens END AS s, greatest(1, {BUDGET - HISTORY_TOKENS} - kept) AS room FROM b
), y(conv_id, i, s, e, room, origin, fresh) AS (
  SELECT conv_id, i, s, e, room, s, true FROM c WHERE i % {BLOCK} = 0
  UNION ALL
  SELECT c.conv_id, c.i, c.s, c.e, c.room, CASE WHEN c.e - y.origin > c.room AND c.s > y.origin THEN c.s ELSE y.origin END, c.e - y.origin > c.room AND c.s > y.origin
  FROM y JOIN c ON c.conv_id IS NOT DISTINCT FROM y.conv_id AND c.i = y.i + 1 AND c.i % {BLOCK} <> 0
), f AS (
  SELECT c.*, y.fresh FROM c JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id AND y.i = c.i
), v AS (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS win FROM f
), q AS (
  SELECT *, least({HISTORY_TOKENS}, {BUDGET} - kept - sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, win)) AS room_left FROM v
), g AS (
  SELECT *, lead(fresh, 1) OVER w AND lead(s, 1) OVER w - s <= lead(room_left, 1) OVER w AS r1, lead(fresh, 2) OVER w AND lead(s, 2) OVER w - s <= lead(room_left, 2) OVER w AS r2,
    max(win) OVER (PARTITION BY conv_id) AS windows FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), h AS (
  SELECT *, CASE WHEN sys THEN windows ELSE 1 + CASE WHEN r1 THEN 1 ELSE 0 END + CASE WHEN r2 THEN 1 ELSE 0 END END AS times,
    length({_ESC.format("role")}) + length({_ESC.format("text")}) + {len(OPEN) + len(CLOSE) + len(END)} AS chars FROM g
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(chars * times) AS BIGINT) AS formatted_chars, CAST(max(windows) AS BIGINT) AS n_windows
FROM h GROUP BY conv_id
"""
