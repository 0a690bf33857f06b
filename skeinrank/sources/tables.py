"""Versioned tables: Parquet in buckets, changed by copy-on-write, with a pointer that is committed last.

A table is a folder. `data/<write>/slot=<bucket>/` holds what one write left of a bucket, and is never
changed. `versions/<n>` lists for each bucket the write that holds it, and ends with a line that says
so. The newest whole list is the table; a reader keeps the version it began with. A write copies the
buckets it touches, puts its list beside the others under the next number, and loses against another
writer who was first. What a crash leaves before that is not listed, so the old version stands;
`vacuum` deletes what no kept version lists.

What is collected is a list of buckets, never rows. A bucket may be any size: it is rewritten by as
many tasks as `split` says.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "end"
#: Seconds that another writer has to finish its list.
PATIENCE = 3.0


class Conflict(RuntimeError):
    """Another writer has committed the version in the meantime."""


class Table:
    """Rows with an int column `bucket`, of `key` one each."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", split: int = 4):
        self.spark, self.path, self.key, self.split = spark, path.rstrip("/"), key, split

    # ------------------------------------------------------------ files of the table

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> list[str]:
        stream = self._fs().open(self._at("versions", name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the whole versions, oldest first."""
        return [int(n) for n in self._names("versions") if n.isdigit() and self._text(n)[-1] == END]

    def _listed(self, version: int | None) -> tuple[T.StructType | None, dict[int, str]]:
        have = self.versions()
        if not have:
            return None, {}
        if version is not None and version not in have:
            raise ValueError(f"{self.path} has no version {version}")
        schema, *lines, _ = self._text(f"{have[-1] if version is None else version:012d}")
        return T.StructType.fromJson(json.loads(schema)), {int(b): w for b, w in (line.split("\t") for line in lines)}

    # ------------------------------------------------------------ reading

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of `buckets` only, if they are given, whose files alone are listed."""
        schema, held = self._listed(version)
        if schema is None:
            raise ValueError(f"{self.path} holds no table")
        return self._of(schema, {b: w for b, w in held.items() if buckets is None or b in set(buckets)})

    def _of(self, schema: T.StructType, held: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{w}/slot={b}" for b, w in sorted(held.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ writing

    def _commit(self, base: int, schema: T.StructType, held: dict[int, str]) -> int:
        """Lists the version after `base`, unless another writer was first. A list that stays unfinished for `PATIENCE` seconds is a
        crashed writer's, and its number is passed over."""
        number, until = base + 1, time.monotonic() + PATIENCE
        while True:
            if max(self.versions(), default=0) > base:
                raise Conflict(f"{self.path} was changed by another writer after version {base}")
            try:
                stream = self._fs().create(self._at("versions", f"{number:012d}"), False)
                break
            except Py4JJavaError as e:
                if "already exists" not in str(e).lower():
                    raise
                if time.monotonic() > until:
                    number, until = number + 1, time.monotonic() + PATIENCE
                time.sleep(0.1)
        try:
            stream.write(bytearray("\n".join([schema.json(), *(f"{b}\t{w}" for b, w in sorted(held.items())), END]).encode()))
        finally:
            stream.close()
        return number

    def _write(self, rows: DataFrame, dealt: bool = False) -> dict[int, str]:
        """Writes rows by bucket: the buckets that got any, with the write's name. Rows that are dealt by bucket already stay where they are."""
        write = uuid.uuid4().hex
        salt = F.pmod(F.xxhash64(self.key), F.lit(self.split))
        rows = rows.withColumn("slot", F.col("bucket"))
        (rows if dealt else rows.repartition("bucket", salt)).write.partitionBy("slot").parquet(f"{self.path}/data/{write}")
        return {int(n.removeprefix("slot=")): write for n in self._names(f"data/{write}") if n.startswith("slot=")}

    def _replace(self, touched: DataFrame, keep, rows: DataFrame) -> int:
        """Rewrites the buckets touched(bucket): what `keep` leaves of the old rows, and `rows`."""
        base = max(self.versions(), default=0)
        schema, held = self._listed(base) if base else (None, {})
        buckets = sorted(r.bucket for r in touched.distinct().collect())
        new = rows
        if schema is not None:
            if {f.name: f.dataType.simpleString() for f in rows.schema} != {f.name: f.dataType.simpleString() for f in schema}:
                raise ValueError("the rows have not the table's columns")
            new = keep(self._of(schema, {b: w for b, w in held.items() if b in set(buckets)})).unionByName(rows.select(*schema.names))
        return self._commit(base, schema or rows.schema, {b: w for b, w in held.items() if b not in set(buckets)} | self._write(new))

    def create(self, rows: DataFrame, dealt: bool = False) -> int:
        """The first version, or one that replaces all rows; `dealt` says that rows lie by bucket: few tasks hold rows of the same one."""
        base = max(self.versions(), default=0)
        return self._commit(base, rows.schema, self._write(rows, dealt))

    def _last(self, rows: DataFrame, order: str | None) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, order)]
        by = F.col(order) if order else F.struct(*rest)
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(self.key, *(f"r.{c}" for c in rest))

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows replace those of their keys, wherever these are; of a key that repeats the last by `order` counts."""
        new = self._last(rows, order)
        if not self.versions():
            return self.create(new)
        keys = new.select(self.key)
        touched = self.read().join(keys, self.key, "left_semi").select("bucket").union(new.select("bucket"))
        return self._replace(touched, lambda old: old.join(keys, self.key, "left_anti"), new)

    def append(self, rows: DataFrame) -> int:
        """Rows whose keys the table lacks, each key once; the others are left as they are."""
        new = self._last(rows, None)
        if not self.versions():
            return self.create(new)
        new = new.join(self.read().select(self.key), self.key, "left_anti")
        return self._replace(new.select("bucket"), lambda old: old, new)

    def replace(self, where: Column, rows: DataFrame) -> int:
        """`rows` in place of all rows for which `where` holds."""
        if not self.versions():
            return self.create(rows)
        touched = self.read().where(where).select("bucket").union(rows.select("bucket"))
        return self._replace(touched, lambda old: old.where(~F.coalesce(where, F.lit(False))), rows)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last `keep`, unfinished lists, and data that no version left lists."""
        have = self.versions()[-keep:] if keep else []
        used = {w for v in have for w in self._listed(v)[1].values()}
        for n in self._names("versions"):
            if not n.isdigit() or int(n) not in have:
                self._fs().delete(self._at("versions", n), False)
        for w in self._names("data"):
            if w not in used:
                self._fs().delete(self._at("data", w), True)

