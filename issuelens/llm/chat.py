"""Preference formatting of chat conversations.

Native: DataFrame functions only. A pair is a chosen and a rejected
conversation, each an array of turns. Their longest common prefix of turns is
rendered once as the prompt; what follows in each is its completion. A
completion comes with its mask as runs: the length of each turn's rendering and
whether it is trained on (turns of the assistant).

``preference_pairs`` makes pairs from single conversations: the conversation
itself is chosen; rejected is the same one with its last answer replaced by the
answer before it, or without its last answer if that is the only one.

Defined results: a null role or text is rendered as an empty one; turns of a
conversation with equal numbers are ordered by role and text, repeated ones all
count; a row without a conv_id belongs to no conversation and is left out; a
conversation without an answer makes equal sides, all prompt and no completion;
if one side is a prefix of the other, its completion is empty; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
#: Rendering of a turn: before the role, between role and text, after the text.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)``; a conversation is one row."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where("conv_id is not null").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(one)).alias("all"))
            .select("conv_id", F.transform("all", lambda t: F.struct(t["role"], t["text"])).cast(f"array<{TURN}>").alias("turns")))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)`` from single conversations."""
    convs = conversations(turns)
    answers = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)), lambda i: i.isNotNull())
    convs = convs.select("conv_id", "turns", answers.alias("answers"))
    last, before = F.element_at("answers", -1), F.get("answers", F.size("answers") - 2)
    other = F.element_at("turns", before)["text"]
    changed = F.concat(F.slice("turns", F.lit(1), last - 1),
                       F.array(F.struct(F.lit(TRAINED).alias("role"), other.alias("text")).cast(TURN)),
                       F.slice("turns", last + 1, F.size("turns")))
    rejected = (F.when(F.size("answers") == 0, F.col("turns"))
                .when(F.size("answers") == 1, F.slice("turns", F.lit(1), F.get("answers", F.lit(0)) - 1))
                .otherwise(changed))
    return convs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def rendered(turns: Column) -> Column:
    """The rendering of each turn."""
    a, b, c = map(F.lit, TEMPLATE)
    return F.transform(turns, lambda t: F.concat(a, t["role"], b, t["text"], c))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``(pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask)`` of ``(pair_id, chosen, rejected)``.

    A mask is an array of ``(length, train)`` over the characters of its completion.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    pairs = pairs.select("pair_id", "chosen", "rejected", F.array_position(same, F.lit(False)).alias("differ"))
    pairs = pairs.select("pair_id", "chosen", "rejected",
                         F.when(F.col("differ") > 0, F.col("differ") - 1).otherwise(F.size("chosen")).cast("int").alias("k"))
    rest = {side: F.slice(side, F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0))) for side in ("chosen", "rejected")}
    pairs = pairs.select("pair_id", F.slice("chosen", F.lit(1), F.col("k")).alias("prompt"), "k",
                         *(c.alias(side) for side, c in rest.items()))

    def mask(side: str) -> Column:
        return F.transform(F.arrays_zip(F.col(side).alias("t"), rendered(F.col(side)).alias("r")), lambda x: F.struct(
            F.length(x["r"]).alias("length"), (x["t"]["role"] == TRAINED).alias("train")))

    return pairs.select("pair_id", F.array_join(rendered(F.col("prompt")), "").alias("prompt"),
                        F.col("k").alias("prompt_turns"),
                        *(F.array_join(rendered(F.col(s)), "").alias(s) for s in ("chosen", "rejected")),
                        *(mask(s).alias(f"{s}_mask") for s in ("chosen", "rejected")))


def format_sql() -> str:
    """``preference_pairs`` and ``format_preferences`` in DuckDB SQL, by windows over turns."""
    a, b, c = ("'{}'".format(x.replace("\n", "' || chr(10) || '")) for x in TEMPLATE)
    show = f"{a} || role || {b} || text || {c}"

    def completion(side: str) -> str:
        return (f"coalesce(string_agg({show}, '' ORDER BY n) FILTER (WHERE side = '{side}' AND n > k), '') AS {side}, "
                f"coalesce(string_agg(length({show}) || ':' || (role = '{TRAINED}')::INT, ',' ORDER BY n) "
                f"FILTER (WHERE side = '{side}' AND n > k), '') AS {side}_mask")

    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
answers AS (
  SELECT conv_id, n, lag(text) OVER (PARTITION BY conv_id ORDER BY n) AS earlier,
         row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM t WHERE role = '{TRAINED}'),
last AS (SELECT conv_id, n AS answer_n, earlier FROM answers WHERE back = 1),
sides AS (
  SELECT conv_id, 'chosen' AS side, n, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'rejected', n, role, CASE WHEN n = answer_n THEN earlier ELSE text END
  FROM t LEFT JOIN last ON t.conv_id = last.conv_id WHERE answer_n IS NULL OR earlier IS NOT NULL OR n < answer_n),
common AS (
  SELECT c.conv_id, coalesce(min(c.n) FILTER (WHERE r.n IS NULL OR r.role <> c.role OR r.text <> c.text) - 1, max(c.n)) AS k
  FROM sides c LEFT JOIN sides r ON r.conv_id = c.conv_id AND r.n = c.n AND r.side = 'rejected'
  WHERE c.side = 'chosen' GROUP BY c.conv_id)
SELECT conv_id AS pair_id, coalesce(string_agg({show}, '' ORDER BY n) FILTER (WHERE side = 'chosen' AND n <= k), '') AS prompt,
       CAST(any_value(k) AS INTEGER) AS prompt_turns, {completion("chosen")}, {completion("rejected")}
FROM sides JOIN common USING (conv_id) GROUP BY conv_id
"""
