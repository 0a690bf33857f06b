"""Deterministic stratified splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _placed(rows: DataFrame, id_col: str, class_col: str, key: Column) -> DataFrame:
    """(id, class, i, n): each row's place by its key within its class, and the class's size.

    A class may hold most rows: it is ranked in buckets of the key's first digits, whose sizes add up to what
    comes before each, so no task sorts a class.
    """
    keyed = rows.select(id_col, class_col, key.alias("__key"), F.substring(key, 1, 4).alias("__bucket"))
    sizes = keyed.groupBy(class_col, "__bucket").agg(F.count("*").alias("m"))
    all_ = W.partitionBy(class_col)
    sizes = sizes.select(class_col, "__bucket", F.sum("m").over(all_).alias("n"), (F.sum("m").over(all_.orderBy("__bucket")) - F.col("m")).alias("before"))
    own = F.row_number().over(W.partitionBy(class_col, "__bucket").orderBy("__key", id_col))
    return keyed.withColumn("j", own).join(sizes, [class_col, "__bucket"]).select(id_col, class_col, (F.col("before") + F.col("j")).alias("i"), "n")


def _classed(rows: DataFrame, id_col: str, class_col: str) -> DataFrame:
    unclassed = F.raise_error(F.concat(F.lit("a row has no class: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    kind = rows.schema[class_col].dataType
    return rows.select(id_col, F.when(F.col(class_col).isNull(), unclassed.cast(kind)).otherwise(F.col(class_col)).alias(class_col))


def stratified_split(rows: DataFrame, id_col: str, class_col: str, ratio: float, seed: str) -> DataFrame:
    """(id, class, partition): of each class the share `ratio`, half to even, at least one and not all, is validation.
    A row without a class, and a class of a single row, are errors."""
    rows = _classed(rows, id_col, class_col)
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col(class_col), F.lit(":"), F.col(id_col).cast("string")), 256)
    placed = _placed(rows, id_col, class_col, key)
    size = F.least(F.greatest(F.bround(F.col("n") * ratio, 0).cast("long"), F.lit(1)), F.col("n") - 1)
    single = F.raise_error(F.concat(F.lit("a class needs two rows or more: "), F.col(class_col).cast("string"))).cast("string")
    return placed.select(id_col, class_col, F.when(F.col("n") < 2, single).when(F.col("i") <= size, "validation").otherwise("test").alias("partition"))


def stratified_sample(rows: DataFrame, id_col: str, class_col: str, size: int, seed: str) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer): one a class, the rest by largest remainders of the classes' shares.
    A row without a class, and fewer places than classes, are errors."""
    rows = _classed(rows, id_col, class_col)
    classes = rows.groupBy(class_col).agg(F.count("*").alias("n"))
    totals = classes.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    quota = classes.crossJoin(F.broadcast(totals)).withColumn("room", F.least(F.lit(size), F.col("total")) - F.col("classes"))  # totals is one row
    few = F.raise_error(F.concat(F.lit(f"{size} rows can't hold a row of each class: "), F.col("classes").cast("string"))).cast("long")
    quota = quota.withColumn("room", F.when(F.col("room") < 0, few).otherwise(F.col("room")))
    exact = F.coalesce(F.try_divide((F.col("n") - 1) * F.col("room"), F.col("total") - F.col("classes")), F.lit(0.0))
    quota = quota.withColumn("whole", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    left = F.first("room").over(W.partitionBy()) - F.sum("whole").over(W.partitionBy())  # a row a class
    quota = quota.withColumn("take", 1 + F.col("whole") + (F.row_number().over(W.orderBy(F.desc("rest"), class_col)) <= left).cast("long")).select(class_col, "take")
    key = F.sha2(F.concat(F.lit(f"stratified-capacity-v1:{seed}:"), F.col(class_col), F.lit(":"), F.col(id_col).cast("string")), 256)
    placed = _placed(rows, id_col, class_col, key)
    return placed.join(F.broadcast(quota), class_col).where(F.col("i") <= F.col("take")).select(id_col, class_col)
