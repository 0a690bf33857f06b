"""Calls of models as a step of a plan, over a table of responses.

A request is what a model is given; its key is a digest of that and of the model's identity. Requests
that are equal are one; those whose key the table holds aren't made again; the rest go to the model,
row by row within a task's batch, as its port has no other form. A reply that fails its check, or a call that raises, is tried once
more; then the request has a fault, and no response. Replies without a fault are appended to the table,
faults are not, so a later run asks for these alone.

The step is eager: calls cost money, so their replies are written before anything reads them, and a lost
executor repeats no finished call. Without a table they are kept for the session only.

Edge cases: null fields are part of the key like any value; requests that repeat have one call and as
many rows as before; an empty table makes no call.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import stored
from ..sources.tables import Table

#: Buckets of a table of responses.
BUCKETS = 16
TRIES = 2

RESPONSES = "key string, response string, bucket int"


def key_of(identity: str, fields: list[str]):
    """The digest under which a request's response stands."""
    return F.sha2(F.concat(F.lit(identity + "\0"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 256)


def ask(requests: DataFrame, fields: list[str], call: Callable[[dict], object], identity: str, reply: str, table: Table | None = None, check: Callable[[object], str | None] | None = None) -> DataFrame:
    """`requests` with `response` (of the type `reply`, null with a fault) and `fault` (null without).

    Columns of these two names are replaced. `call` makes a reply, which JSON can hold, of a request's fields by name; `check` says what is wrong with it, if anything.
    """
    requests = requests.drop("response", "fault")
    keyed = requests.withColumn("__key", key_of(identity, fields))
    each = keyed.groupBy("__key").agg(*(F.any_value(f).alias(f) for f in fields))
    held = table.read().select(F.col("key").alias("__key"), "response") if table is not None and table.versions() else None
    missing = each if held is None else each.join(held, "__key", "left_anti")

    def run(batches):
        for batch in batches:
            keys, replies, faults = batch["__key"], [], []
            for row in batch.select(fields).to_pylist():
                said, fault = None, None
                for _ in range(TRIES):
                    try:
                        said = call(row)
                        fault = check(said) if check is not None else None
                    except Exception as e:  # noqa: BLE001 a model's failure is a fault of this request, not of the plan
                        fault = f"{type(e).__name__}: {e}"
                    if fault is None:
                        break
                replies.append(None if fault else json.dumps(said, ensure_ascii=False))
                faults.append(fault)
            yield pa.RecordBatch.from_arrays([keys, pa.array(replies, pa.string()), pa.array(faults, pa.string())], ["__key", "response", "fault"])

    made = stored(missing.mapInArrow(run, "__key string, response string, fault string"), "replies")
    good = made.where("fault IS NULL")
    if table is not None:
        table.append(good.select(F.col("__key").alias("key"), "response", F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)).cast("int").alias("bucket")))
    known = made if held is None else made.unionByName(held.withColumn("fault", F.lit(None).cast("string")))
    kind = T._parse_datatype_string(reply)
    # a reply is packed, so that texts and numbers are JSON, too
    value = F.from_json(F.concat(F.lit('{"v": '), F.col("__reply"), F.lit("}")), T.StructType([T.StructField("v", kind)]))["v"]
    both = keyed.join(known.select("__key", F.col("response").alias("__reply"), F.col("fault").alias("__fault")), "__key", "left")
    return both.select(*requests.columns, value.alias("response"), F.col("__fault").alias("fault"))


def response_table(spark, path: str) -> Table:
    return Table(spark, path, key="key", split=1)
