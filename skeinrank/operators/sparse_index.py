"""A stored inverted index with block maxima, and an exact search that skips blocks.

Chunks are dealt to blocks of about `BLOCK` by a hash of their id; a row of the index holds a term's
postings in one block, with the most occurrences and the shortest chunk among them. Rows lie in
buckets of terms, so a search lists the files of its terms' buckets only. Lengths are in a table of
their own, which gives the number of chunks and their mean length after every change.

An occurrence counts the more, the more there are and the shorter the chunk is, so a block's two
extremes bound what a term can give there, whatever the mean length is by then. A search takes two steps. First the
bounds of all blocks are added up from the narrow columns, and the `FIRST` best blocks of a question are
scored exactly: their k-th best score is its threshold. Then those other blocks are scored whose bound
reaches it. What is skipped can't be among the k best, ties included.

Edge cases: a chunk without terms counts for the mean length and is never hit; of an id that repeats
the last by the order given stays; ids that are null are left out; a question without known terms has no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.readers import stored
from ..sources.tables import Table
from .chunking import latest_chunks
from .retrieve import K1, B, ranked

#: Chunks of a block (about), chunks for each bucket of terms, buckets at least and at most, and blocks of a question that are scored first.
BLOCK, PER_BUCKET, FEWEST, MOST, FIRST = 64, 10_000, 8, 1024, 8
#: Parts that all buckets together are packed in when an index is built, about: with more buckets than that a bucket is one.
PARTS = 32
#: Scores are rounded to six digits: a bound may be that much too low.
ROUNDED = 1e-6


class SparseIndex:
    def __init__(self, spark: SparkSession, path: str, analyzer: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer
        self.rows = Table(spark, f"{self.path}/postings", key="term", split=1)
        self.lengths = Table(spark, f"{self.path}/lengths", key="chunk_id", split=1)
        self._shape: tuple[int, int] | None = None

    @property
    def shape(self) -> tuple[int, int]:
        """Blocks and buckets: fixed when the index is built."""
        if self._shape is None:
            self._shape = tuple(self.spark.read.parquet(f"{self.path}/shape").head())
        return self._shape

    @property
    def blocks(self) -> int:
        return self.shape[0]

    @classmethod
    def build(cls, spark: SparkSession, path: str, chunks: DataFrame, analyzer: Callable[[Column], Column] = tokens, order: str | None = None, block: int = BLOCK) -> SparseIndex:
        """chunks(chunk_id, text), with `order` the last row of an id counts, else ids mustn't repeat."""
        self = cls(spark, path, analyzer)
        own = self._known(chunks, order)
        n = own.count()
        self._shape = max(1, -(-n // block)), int(min(MOST, max(FEWEST, n // PER_BUCKET)))
        spark.createDataFrame([self._shape], "blocks long, buckets long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/shape")
        counted = self._counted(own)
        self.lengths.create(self._lengths(counted))
        # postings are shuffled once: by bucket, in which they are packed and written; few buckets are dealt in parts
        part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(max(1, PARTS // self.shape[1]))).cast("int")
        dealt = self._postings(counted).select("term", "chunk_id", "tf", "len", self._bucket().alias("bucket"), part.alias("part")).repartition("bucket", "part")
        self.rows.create(self._packed(dealt.withColumn("block", self._block()), "bucket", "part"), dealt=True)
        return self

    # ------------------------------------------------------------ what is stored

    def _known(self, chunks: DataFrame, order: str | None) -> DataFrame:
        own = chunks.where("chunk_id IS NOT NULL")
        return (latest_chunks(own, order) if order else own).select("chunk_id", "text")

    def _counted(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", self.analyzer(F.coalesce("text", F.lit(""))).alias("words"))

    def _lengths(self, counted: DataFrame) -> DataFrame:
        return counted.select("chunk_id", F.size("words").alias("len"), F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, self.shape[1] // 8))).cast("int").alias("bucket"))

    def _postings(self, counted: DataFrame) -> DataFrame:
        """(term, block, chunk_id, tf, len); a chunk's terms are counted in its own row, so nothing is shuffled yet."""
        words = counted.select("chunk_id", F.size("words").alias("len"), F.array_sort("words").alias("words"))
        ends = F.filter(F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), i)), lambda i: i.isNotNull())
        words = words.withColumn("at", F.concat(ends, F.array(F.size("words"))))
        each = words.select("chunk_id", "len", "words", F.explode(F.arrays_zip(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))).alias("a"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))).alias("b"))).alias("x"))
        return each.select(F.get("words", F.col("x.a")).alias("term"), self._block().alias("block"), "chunk_id", (F.col("x.b") - F.col("x.a")).alias("tf"), "len")

    def _packed(self, postings: DataFrame, *dealt: str) -> DataFrame:
        """`dealt`: what postings are dealt by already, which follows from the term."""
        packed = postings.groupBy(*dealt, "term", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("chunk_id", "tf", "len")).alias("held"))
        return packed.select("term", "block", "n", "max_tf", "min_len", "held", self._bucket().alias("bucket"))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(self.blocks))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.shape[1])).cast("int")

    def upsert(self, chunks: DataFrame, order: str | None = None) -> None:
        """Chunks in place of those of their ids: the blocks they belong to are packed anew."""
        counted = self._counted(self._known(chunks, order))
        new = self._postings(counted)
        # of the ids, as a chunk may come back without a term
        blocks = counted.select(self._block().alias("block")).distinct()
        old = self.rows.read().join(blocks, "block", "left_semi")
        left = old.select("term", "block", F.inline("held")).join(counted.select("chunk_id"), "chunk_id", "left_anti")
        rows = stored(self._packed(left.select(new.columns).unionByName(new)), "packed")
        touched = old.select("bucket").union(rows.select("bucket"))
        self.rows._replace(touched, lambda held: held.join(blocks, "block", "left_anti"), rows)
        self.lengths.upsert(self._lengths(counted))

    # ------------------------------------------------------------ search

    def search(self, questions: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """The k best chunks of questions(question_id, text) by BM25: all that hold a term are ranked, as without an index."""
        pairs, scored = self._steps(questions, k, first)
        return ranked(scored, k)

    def _steps(self, questions: DataFrame, k: int, first: int) -> tuple[DataFrame, DataFrame]:
        """((question_id, block, bound, place) of all blocks with a term, scores of the blocks looked at)."""
        asked = questions.select("question_id", F.explode(self.analyzer(F.coalesce("text", F.lit("")))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
        asked = asked.withColumn("bucket", self._bucket())
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # MOST at most
        held = self.rows.read(buckets)
        total = self.lengths.read().agg(F.count("*").alias("n"), F.avg("len").alias("mean")).head()
        n, mean = total.n, max(total.mean or 0.0, 1e-300)
        narrow = held.select("term", "block", "n", "max_tf", "min_len")
        df = narrow.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        worth = stored(asked.join(df, "term").select("question_id", "term", (F.col("times") * idf).alias("w")), "worth")
        gives = lambda tf, length: F.col("w") * F.col(tf) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean))
        bounds = worth.join(narrow, "term").groupBy("question_id", "block").agg(F.sum(gives("max_tf", "min_len")).alias("bound"))
        bounds = stored(bounds.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("bound"), "block"))), "bounds")

        def exact(pairs):
            # of the buckets' rows only those of terms asked for are shuffled
            asked_for = held.select("term", "block", "held").join(worth.select("term").distinct(), "term", "left_semi")
            rows = worth.join(pairs.select("question_id", "block"), "question_id").join(asked_for, ["term", "block"])
            rows = rows.select("question_id", "w", F.inline("held"))
            return rows.groupBy("question_id", "chunk_id").agg(F.round(F.sum(gives("tf", "len")), 6).alias("score"))

        begun = stored(exact(bounds.where(F.col("place") <= first)), "first-blocks")
        last = ranked(begun, k).where(F.col("rank") == k).select("question_id", F.col("score").alias("bar"))
        rest = bounds.where(F.col("place") > first).join(last, "question_id", "left").where(F.col("bound") >= F.coalesce("bar", F.lit(0.0)) - ROUNDED)
        return bounds, begun.unionByName(exact(rest))

    def looked_at(self, questions: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """(question_id, blocks, scored): the blocks with a term of the question, and how many of them hold chunks that were scored."""
        bounds, scored = self._steps(questions, k, first)
        own = scored.select("question_id", self._block().alias("block")).distinct().groupBy("question_id").agg(F.count("*").alias("scored"))
        return bounds.groupBy("question_id").agg(F.count("*").alias("blocks")).join(own, "question_id", "left")
