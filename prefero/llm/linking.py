"""Classes of what links tie together, by joins on Spark; and whole groups out of a stream of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefero.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """id, comp: the least number that each linked one reaches, by rounds of least labels and jumps.

    Labels spread over doubling distances, so rounds grow with the logarithm of the longest chain.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))]))
    both = staged(links.select(ends.alias("e")).select("e.*").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = labels.select("id", "comp").join(jump, "comp").join(heard, "id")
        new = staged(new.select("id", F.least("comp", "further", "heard").alias("comp"), F.col("comp").alias("before")), "labels")
        discard(labels)
        labels = new
        if not new.where("comp != before").limit(1).count():
            return new.select("id", "comp")


def renamed(comps: DataFrame, number: str, comp: str) -> DataFrame:
    return comps.select(F.col("id").alias(number), F.col("comp").alias(comp))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` joined up by further links between its classes."""
    if not links.limit(1).count():
        return comps
    of = links.join(renamed(comps, "a", "x"), "a", "left").join(renamed(comps, "b", "y"), "b", "left")
    between = of.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct()
    joined = components(between)
    alone = between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").select("id", F.col("id").alias("comp"))
    every = comps.union(alone).join(renamed(joined, "comp", "whole"), "comp", "left")
    return staged(every.select("id", F.coalesce("whole", "comp").alias("comp")), "classes")


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Frames of about ``most`` rows that end where a key ends; the rows come sorted by key."""
    held: list[pd.DataFrame] = []
    n = 0
    for rows in batches:
        if not len(rows):
            continue
        held.append(rows)
        n += len(rows)
        if n < most:
            continue
        rows = pd.concat(held, ignore_index=True)
        others = (rows[key] != rows[key].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        at = int(others[-1]) + 1 if len(others) else 0
        if at:
            yield rows.iloc[:at].reset_index(drop=True)
        held, n = [rows.iloc[at:]], len(rows) - at
    if n:
        yield pd.concat(held, ignore_index=True)
