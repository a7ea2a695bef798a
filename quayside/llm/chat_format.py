"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

One shuffle brings the turns of a pair together; everything else is array expressions inside that row: the longest common prefix
of turns comes from comparing the two sorted turn arrays place by place, and is rendered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _segments(turns: Column) -> Column:
    """Every turn as its heading, which is never learnt, and its body with the closing mark, learnt if the assistant's."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), t["role"], F.lit("\n")).alias("text"), F.lit(0).alias("loss")),
                F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == "assistant").cast("int").alias("loss")),
            ),
        )
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Format pairs of conversations, each given as its turns: pair_id, turn, role, text (other columns are ignored).

    Returns one row per pair_id: n_prompt_turns, prompt (the longest common prefix of turns, rendered once), and chosen and
    rejected, each an array of (text, loss) segments that, joined, render the remaining turns; loss is 1 on what the assistant
    says, with the mark that ends it, and 0 on headings and other roles.

    Edge cases: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed place; a null role
    counts as "user", a null text as empty; a pair with one side only has no common turns and null for the other side; if one side
    is a prefix of the other, its segments are empty; turns with a null pair_id are left out; empty tables give an empty result.
    """
    # the side is a column of one union, so a pair is gathered in a single shuffle
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sides = [df.where("pair_id is not null").select("pair_id", F.lit(side).alias("side"), turn.alias("t")) for side, df in ((True, chosen), (False, rejected))]
    pairs = sides[0].unionByName(sides[1]).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))

    def rest(side: str) -> Column:
        return F.when(F.size(side) > 0, _segments(F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))))

    return pairs.select("pair_id", F.col("n").alias("n_prompt_turns"), _render(F.slice("c", 1, F.col("n"))).alias("prompt"), rest("c").alias("chosen"), rest("r").alias("rejected"))


def adjacent_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations 2p (chosen) and 2p + 1 (rejected) as the two sides of pair p: (chosen turns, rejected turns)."""
    turns = conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    return turns.where("side = 0").drop("side"), turns.where("side = 1").drop("side")


def preference_texts(pairs: DataFrame) -> DataFrame:
    """:func:`preference_pairs` with each side as one text and a mask: comma-joined loss:characters of its segments."""

    def text(side: str) -> Column:
        return F.array_join(F.transform(side, lambda s: s["text"]), "")

    def mask(side: str) -> Column:
        return F.array_join(F.transform(side, lambda s: F.concat_ws(":", s["loss"].cast("string"), F.length(s["text"]).cast("string"))), ",")

    return pairs.select("pair_id", "n_prompt_turns", "prompt", text("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), text("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))


_SIDE = """
  SELECT pair_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM turns WHERE side = {side} GROUP BY pair_id"""
_TEXT = "array_to_string(list_transform({0}, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')"
_MASK = "array_to_string(list_transform({0}, lambda x: '0:' || CAST(13 + length(x.role) AS VARCHAR) || ',' || (CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END) || ':' || CAST(length(x.text) + 11 AS VARCHAR)), ',')"
ORACLE = (
    "WITH turns AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, COALESCE(role, 'user') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),"
    + " c AS (" + _SIDE.format(side=0) + "), r AS (" + _SIDE.format(side=1) + "),"
    + """ both_sides AS (
  SELECT COALESCE(c.pair_id, r.pair_id) AS pair_id, c.t AS c, r.t AS r,
    COALESCE(list_min(list_filter(range(1, least(len(c.t), len(r.t)) + 1), lambda i: c.t[i] <> r.t[i])) - 1, least(len(c.t), len(r.t))) AS k
  FROM c FULL JOIN r ON c.pair_id = r.pair_id),
cut AS (SELECT pair_id, CASE WHEN c IS NULL OR r IS NULL THEN 0 ELSE k END AS n, c, r FROM both_sides),
parts AS (SELECT pair_id, n, list_slice(c, 1, n) AS p, list_slice(c, n + 1, len(c)) AS c, list_slice(r, n + 1, len(r)) AS r FROM cut)
SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns, COALESCE(""" + _TEXT.format("p") + ", '') AS prompt, "
    + _TEXT.format("c") + " AS chosen, " + _MASK.format("c") + " AS chosen_mask, " + _TEXT.format("r") + " AS rejected, " + _MASK.format("r") + " AS rejected_mask FROM parts"
)
