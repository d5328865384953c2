"""Preference pairs: the common prompt once, and both completions with loss spans (DataFrame functions only).

A pair has a chosen and a rejected conversation.  Its prompt is their longest common prefix of
turns: the turns before the first turn number at which the two differ.  The result is one record
a pair and block of BLOCK turn numbers (ordinary conversations are one block), so a conversation of
any length never meets in one row or task:

    pair_id, block, n_turns, prompt, chosen, rejected, chosen_spans, rejected_spans

A turn is rendered as `<|role|>`, a line feed, its text, a line feed, `<|end|>` and a line feed; `<|` in a
role or text is written `<||`, so no text can forge a turn (replace `<||` by `<|` to read it).  Spans are the
characters of a completion to train on, `from:to` joined by commas: the text and end of each
assistant turn, never a header and never the prompt.

Defined cases: a null turn counts as turn -1; null role or text count as empty; a row repeated
within a conversation counts once; different messages of one turn are compared as a set and rendered
in order of role and text; a side that is missing or ends early leaves the other's turns as its
completion; equal sides are all prompt; very long texts are rendered whole; rows without a conversation
id belong to no pair and are left out; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

OPEN, CLOSE, TRAINED, BLOCK = ("<|", "|>\n"), "<|end|>\n", "assistant", 64


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN[0]), escaped(role), F.lit(OPEN[1]))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), escaped(text), F.lit("\n" + CLOSE))


def _spans(turns: Column) -> Column:
    """`from:to` of the trained characters of rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x["rendered"])
        span = F.concat((s["at"] + x["head"]).cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["trained"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: F.array_join(s["spans"], ","))


def format_pairs(turns: DataFrame) -> DataFrame:
    """The records above out of (pair_id, is_chosen, turn, role, text)."""
    turns = turns.where(F.col("pair_id").isNotNull() & F.col("is_chosen").isNotNull()).select(
        "pair_id",
        "is_chosen",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    messages = turns.groupBy("pair_id", "turn", "role", "text").agg(F.bool_or("is_chosen").alias("chosen"), F.bool_or(~F.col("is_chosen")).alias("rejected"))
    differs = messages.groupBy("pair_id").agg(F.min(F.when(~(F.col("chosen") & F.col("rejected")), F.col("turn"))).alias("differs"))
    joined = messages.join(differs, "pair_id")
    prompt = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    shown = [F.length(header(F.col("role"))).alias("head"), rendered(F.col("role"), F.col("text")).alias("rendered"), (F.col("role") == TRAINED).alias("trained")]
    row = F.struct("turn", "role", "text", prompt.alias("prompt"), "chosen", "rejected", *shown)
    blocks = joined.select("pair_id", F.floor(F.greatest("turn", F.lit(0)) / BLOCK).alias("block"), row.alias("row"))
    whole = blocks.groupBy("pair_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["rendered"]), "")
    sides = whole.select(
        "pair_id",
        "block",
        F.size("rows").cast("long").alias("n_turns"),
        F.filter("rows", lambda x: x["prompt"]).alias("p"),
        F.filter("rows", lambda x: ~x["prompt"] & x["chosen"]).alias("c"),
        F.filter("rows", lambda x: ~x["prompt"] & x["rejected"]).alias("r"),
    )
    return sides.select("pair_id", "block", "n_turns", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: pair n is conversation n up to its last assistant turn.

    That turn's answer is chosen; the last answer of the neighbour (2n and 2n + 1 are neighbours) is
    rejected in its place.  A conversation that has no answer, or whose neighbour has none, makes no pair.
    """
    conv = F.col("conv_id").cast("long")
    said = conversations.where("conv_id IS NOT NULL").select(conv.alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    answers = said.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("answer")).select("pair_id", F.col("answer.turn").alias("last"), F.col("answer.text").alias("answer"))
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other"))
    both = answers.join(other, "pair_id")
    whole = said.join(both, "pair_id").where("turn <= last")
    answer = (F.col("turn") == F.col("last")) & (F.col("role") == TRAINED) & (F.col("text") == F.col("answer"))
    side = F.when(answer, F.array(F.struct(F.lit(True).alias("is_chosen"), F.col("text").alias("said")), F.struct(F.lit(False).alias("is_chosen"), F.col("other").alias("said"))))
    side = side.otherwise(F.array(*[F.struct(F.lit(x).alias("is_chosen"), F.col("text").alias("said")) for x in (True, False)]))
    return whole.select("pair_id", "turn", "role", F.explode(side).alias("side")).select("pair_id", "side.is_chosen", "turn", "role", F.col("side.said").alias("text"))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(paired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP10_SQL = """
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) AS k FROM said WHERE role = 'assistant'
), answers AS (SELECT pair_id, turn AS last_turn, text AS answer FROM ranked WHERE k = 1),
matched AS (SELECT a.*, o.answer AS other FROM answers a JOIN answers o ON xor(a.pair_id, CAST(1 AS BIGINT)) = o.pair_id),
chosen AS (SELECT DISTINCT pair_id, turn, role, text FROM said JOIN matched USING (pair_id) WHERE turn <= last_turn),
rejected AS (
  SELECT c.pair_id, turn, role, text FROM chosen c JOIN matched USING (pair_id) WHERE NOT (turn = last_turn AND role = 'assistant' AND text = answer)
  UNION SELECT pair_id, last_turn, 'assistant', other FROM matched
), odd AS (
  SELECT pair_id, turn FROM ((SELECT * FROM chosen EXCEPT SELECT * FROM rejected) UNION ALL (SELECT * FROM rejected EXCEPT SELECT * FROM chosen))
), parting AS (SELECT pair_id, min(turn) AS differs FROM odd GROUP BY pair_id),
sided AS (SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r', * FROM rejected),
shown AS (
  SELECT s.*, CASE WHEN differs IS NULL OR turn < differs THEN 'p' ELSE side END AS part, greatest(turn, 0) // 64 AS block,
    '<|' || replace(role, '<|', '<||') || '|>' || chr(10) AS head, replace(text, '<|', '<||') || chr(10) || '<|end|>' || chr(10) AS body
  FROM sided s LEFT JOIN parting USING (pair_id)
), once AS (SELECT DISTINCT pair_id, block, part, turn, role, text, head, body FROM shown),
placed AS (
  SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY pair_id, block, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM once
), spans AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CAST(CAST(begin_at AS BIGINT) + length(head) AS VARCHAR) || ':' || CAST(CAST(begin_at AS BIGINT) + length(head || body) AS VARCHAR) END AS span FROM placed
), counted AS (SELECT pair_id, block, count(*) AS n_turns FROM (SELECT DISTINCT pair_id, block, turn, role, text FROM shown) GROUP BY ALL)
SELECT pair_id, block, any_value(n_turns) AS n_turns,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (part = 'p'), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (part = 'c'), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'c' AND span IS NOT NULL), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'r' AND span IS NOT NULL), '') AS rejected_spans
FROM spans JOIN counted USING (pair_id, block) GROUP BY pair_id, block
"""
