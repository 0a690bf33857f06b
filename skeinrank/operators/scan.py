"""Sequences of any length: ordered scans in two levels, so that one key may hold all rows.

Rows are dealt by ranges of key and order, which cut a long sequence in segments of like size. Each
segment is summed up in a row; a scan over these rows, as many as there are segments, says what comes
before each; a second pass over the segments uses that. No task holds more than a segment or, for one
key, the summaries. The order must tell a key's rows apart; rows that it doesn't stay in one segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.readers import stored


def segmented(rows: DataFrame, key: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """`rows` with `__seg`, written: numbers that rise with key and order. Ranges are sampled, so a plan made anew would cut elsewhere."""
    n = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *key, *order).withColumn("__seg", F.spark_partition_id()), "segments")


def failure_runs(events: DataFrame, key: list[str], order: list[str], failed: str, limit: int, segments: int | None = None) -> DataFrame:
    """`events` with `__open`: whether `limit` failures in a row stand somewhere before the row."""
    rows = segmented(events, key, order, segments)
    own = W.partitionBy(*key, "__seg").orderBy(*order)
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__won", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(so_far))
    run = W.partitionBy(*key, "__seg", "__won").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.when(F.col(failed), 1).otherwise(0)).over(run))
    # a segment: its successes, the failures that it begins and ends with, and its longest run
    ends = rows.groupBy(*key, "__seg").agg(
        F.max("__won").alias("won"), F.count_if(F.col(failed) & (F.col("__won") == 0)).alias("lead"),
        F.max_by("__run", F.struct(*order)).alias("tail"), F.max("__run").alias("longest"),
    )
    by_segment = W.partitionBy(*key).orderBy("__seg")
    # failures that run on over whole segments add up until one has a success
    ends = ends.withColumn("island", F.sum((F.col("won") > 0).cast("int")).over(by_segment.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("ending", F.sum("tail").over(W.partitionBy(*key, "island").orderBy("__seg").rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("__carry", F.coalesce(F.lag("ending").over(by_segment), F.lit(0)))
    reached = F.greatest(F.col("longest"), F.col("__carry") + F.col("lead")) >= limit
    ends = ends.withColumn("__before", F.coalesce(F.max(reached).over(by_segment.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    both = rows.join(ends.select(*key, "__seg", "__carry", "__before"), [*key, "__seg"])
    here = F.col("__run") + F.when(F.col("__won") == 0, F.col("__carry")).otherwise(0) >= limit
    inside = F.coalesce(F.max(here).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return both.withColumn("__open", F.col("__before") | inside).select(*events.columns, "__open")


def previous(rows: DataFrame, key: list[str], order: list[str], columns: dict[str, str], segments: int | None = None) -> DataFrame:
    """`rows` with the row before in its key's order: columns maps new names to those of the columns read there; null for the first."""
    cut = segmented(rows, key, order, segments)
    at = F.struct(*order)
    ends = cut.groupBy(*key, "__seg").agg(*(F.max_by(F.struct(c), at).alias(n) for n, c in columns.items()), F.lit(True).alias("__has"))
    by_segment = W.partitionBy(*key).orderBy("__seg")
    ends = ends.select(*key, "__seg", *(F.lag(n).over(by_segment)[c].alias(f"__p_{n}") for n, c in columns.items()))
    own = W.partitionBy(*key, "__seg").orderBy(*order)
    inside = cut.withColumn("__first", F.row_number().over(own) == 1)
    for n, c in columns.items():
        inside = inside.withColumn(f"__l_{n}", F.lag(c).over(own))
    both = inside.join(ends, [*key, "__seg"])
    return both.select(*rows.columns, *(F.when(F.col("__first"), F.col(f"__p_{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in columns))


def running_before(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, segments: int | None = None) -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows before in the key's order."""
    cut = segmented(rows, key, order, segments)
    sums = cut.groupBy(*key, "__seg").agg(F.sum(value).alias("__sum"))
    by_segment = W.partitionBy(*key).orderBy("__seg")
    sums = sums.select(*key, "__seg", (F.sum("__sum").over(by_segment) - F.col("__sum")).alias("__base"))
    own = W.partitionBy(*key, "__seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = cut.withColumn("__in", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(sums, [*key, "__seg"]).select(*rows.columns, (F.col("__base") + F.col("__in")).alias(name))
