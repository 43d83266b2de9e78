"""Operator 2, preference formatting with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt;
what follows it in each becomes a completion with spans that say which characters are trained on (the
texts of assistant turns and their end marks).

The rows of one conversation are gathered, because one output row renders them; pairs never are. Turns
are sorted by turn, then role, then text. Defined results: a null role reads as "unknown" and a null text
as empty, nulls compare equal; repeated turns stay; a pair with one side only has an empty prompt and no
completion on the other side (null); identical sides have empty completions; rows with a null pair_id are
one pair of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the template
OPEN, MIDDLE, CLOSE, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """(start, length, trained) in characters of the rendered completion, for every turn's head and body."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,trained:boolean>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        body = F.length(t["text"]) + len(CLOSE)
        new = F.array(F.struct(acc["at"].alias("start"), head.alias("length"), F.lit(False).alias("trained")),
                      F.struct((acc["at"] + head).alias("start"), body.alias("length"), (t["role"] == TRAINED).alias("trained")))
        return F.struct((acc["at"] + head + body).alias("at"), F.concat(acc["spans"], new).alias("spans"))

    return F.aggregate(turns, empty, add, lambda acc: acc["spans"])


def preference_format(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From two tables (pair_id, turn, role, text): pair_id, n_common (turns of the prompt), prompt,
    chosen, rejected, chosen_spans, rejected_spans. One shuffle, on pair_id."""
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = (chosen.select("pair_id", F.lit(True).alias("side"), turn.alias("t"))
            .unionByName(rejected.select("pair_id", F.lit(False).alias("side"), turn.alias("t"))))
    sides = both.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    same = F.transform(F.arrays_zip("c", "r"), lambda z: (z["c"]["role"] == z["r"]["role"]) & (z["c"]["text"] == z["r"]["text"]))
    differs = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    common = F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int")
    rest = sides.withColumn("k", common).select(
        "pair_id", F.col("k").alias("n_common"), F.slice("c", F.lit(1), F.col("k")).alias("p"),
        F.when(F.size("c") > 0, F.slice("c", F.col("k") + 1, F.size("c"))).alias("c"),
        F.when(F.size("r") > 0, F.slice("r", F.col("k") + 1, F.size("r"))).alias("r"))
    return rest.select("pair_id", "n_common", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
                       _render(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_spans"),
                       _spans(F.col("r")).alias("rejected_spans"))
