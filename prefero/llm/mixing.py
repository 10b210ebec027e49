"""Mixing sources to target weights.

Tokens are summed per source, targets give each source a repetition rate, and
each document is emitted ``floor(rate)`` times plus one Bernoulli copy whose
hash-seeded draw falls below the rate's fraction.

Null texts have size 0; a null source is a source of its own, sorted last.
Repeated rows draw alike, since the draw depends on seed and doc_id alone.
Texts count whole, however long.  Empty input gives an empty result; extra columns pass through,
and one named as a result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefero.llm.common import id_text, small_side, staged, unused, word_count

#: Bits of md5 that make one uniform draw.
DRAW_BITS = 52


def source_targets(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: mix_source, source_size, target, rate.

    Sources sorted by code point (null last) take the weights in turn and share
    the total size by them.  No target exceeds ``cap`` times its source's size;
    the excess is shared again by weight.  That is one water level: the target
    is min(cap * size, level * weight), and the level follows from the sources
    sorted by cap * size / weight.  The windows run over one row per source.
    """
    per = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    per = per.withColumn("n", F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.col("n") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_cut = W.orderBy(F.col("most") / F.col("weight"), "n")
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(by_cut) - F.col("most"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(by_cut) - F.col("weight")))
    per = per.withColumn("level", level)
    # the first source, from the lowest cut, whose level stays below its cut has the level of all
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "n", "level"))
    per = per.withColumn("level", F.coalesce(F.min(fits).over(everything)["level"], F.lit(0.0)))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return per.select(
        "mix_source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), target / F.col("source_size"))).otherwise(0.0).alias("rate"),
    )


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out``: size, source_size, target, rate, copies.

    The table of sources is staged, and broadcast once its measured size is known
    to be small; otherwise it joins by shuffle, where AQE splits a hot source.
    """
    targets = small_side(staged(source_targets(docs, weights, cap), "sources"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text("doc_id"))), 1, DRAW_BITS // 4), 16, 10).cast("long") / F.lit(float(1 << DRAW_BITS))
    whole = F.floor(targets["rate"])
    copies = whole + F.when(draw < targets["rate"] - whole, 1).otherwise(0)
    plan = F.struct(
        word_count(docs["text"]).alias("size"),
        targets["source_size"],
        targets["target"],
        targets["rate"],
        copies.cast("long").alias("copies"),
    )
    return docs.join(targets, docs["source"].eqNullSafe(targets["mix_source"])).select(*[docs[c] for c in docs.columns if c != out], plan.alias(out))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with mix_copy from 1 (a longer name where the table has that one)."""
    plan = unused("mix", docs)
    planned = mix_plan(docs, weights, cap, seed, plan).where(f"`{plan}`.copies > 0")
    return planned.withColumn(unused("mix_copy", docs), F.explode(F.sequence(F.lit(1), F.col(f"{plan}.copies").cast("int")))).drop(plan)
