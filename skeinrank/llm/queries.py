"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import html_text, language_id, toxicity
from .byte_bpe import bpe_encode
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .license_scan import license_scan
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .shared import materialize, scratch_folder, scratch_root, short_batches, table
from .simhash import simhash_dedup
from .token_counts import local_path, read_token_files, token_counts, write_token_files, write_tokens
from .vector_codes import books_digest, compress

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The flat files' vocabulary, whose id 50256 is free, and so ends a document.
FILE_VOCABULARY, END_OF_DOCUMENT = "byte_bpe_50k.tiktoken", 50256
#: How severe an objection the raters had: none, to the text's quality, to its being toxic; and the grade that is bad.
GRADE, BAD = "CASE WHEN toxic > 0 THEN 2 WHEN toxic = 0 THEN CASE WHEN quality = 0 THEN 1 ELSE 0 END END", 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language_id.fit(docs.where(~held_out))  # nor is a null id learned from
    return language_id.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": F.coalesce(held_out, F.lit(False))})


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents go to flat token files in the shared folder, whose separators are then found again; where Python can't
    open that folder, to blocks in a table."""
    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizers.path(FILE_VOCABULARY)
    root = local_path(scratch_root(spark))
    if root is None:
        made = materialize(write_tokens(docs, vocabulary, public_tokenizers.PATTERN, END_OF_DOCUMENT), "token-files")
        before = F.coalesce(F.sum(F.size("ids")).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        blocks, listed = made, made.select("file", "ids", before.alias("first"))
    else:
        folder = scratch_folder(spark, "token-files")
        listed = materialize(write_token_files(docs, local_path(folder), vocabulary, public_tokenizers.PATTERN, END_OF_DOCUMENT), "listed")
        listed = listed.withColumn("file", F.element_at(F.split("file", "/"), -1))
        # a retried task's first file isn't listed
        blocks = read_token_files(spark, folder if not listed.isEmpty() else scratch_root(spark), only=listed.select(F.col("file").alias("name")))
        blocks = blocks.withColumn("file", F.element_at(F.split("file", "/"), -1))
    counts = token_counts(blocks, END_OF_DOCUMENT)
    names = listed.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).cast("long").alias("doc"), "doc_id")
    return counts.join(names, ["file", "doc"]).select("doc_id", "file", "first_token", "n_tokens")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), GRADE, bad_from=BAD)
    return toxicity.severity(docs, model).withColumn("rejected", F.col("severity") >= model.reject)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=4, p=85, q=100)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of doc_id, stand for the snapshot; the rest come in as the batch."""
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i))
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(n_hit)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest",
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), width=4, radius=4, seed=42)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    coded = materialize(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, positives=5, negatives=3, label=label, scale=256)


def _short(query):
    """With short Arrow batches for the session, as texts may be long: this is the application's choice, not the operators'."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _short(f)
    for f in (op1_language_id, op2_html_text, op3_ngram_join, op4_token_counts, op5_license_scan, op6_line_dedup, op7_exact_dedup, op8_byte_bpe, op9_decontaminate, op10_toxicity, op11_simhash, op12_vector_codes, op13_hard_negatives)
}

_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Vectors that are whole, as integers.
_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after the other, every part against every entry."""
    ctes = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_WHOLE})",
        f"cut AS (SELECT vec_id, p.p AS p, list_slice(v, (p.p * (len(v) // {parts}) + 1)::INT, ((p.p + 1) * (len(v) // {parts}))::INT) AS x FROM kept, (SELECT unnest(range({parts})) AS p) p)",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best FROM cut JOIN b{r} USING (p) GROUP BY vec_id, p, x)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{r}) GROUP BY p, e, i)")
            ctes.append(f"m{r} AS (SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY p, e)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return f"""WITH {', '.join(ctes)},
        w AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM w JOIN kept USING (vec_id), h"""


ORACLE_SQL = {
    "op12_vector_codes": _codes_sql(),
    "op13_hard_negatives": f"""
        WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
                      FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_WHOLE}),
        s AS MATERIALIZED (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
                           FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT a, r AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= 5),
        n AS (SELECT p.a, positive, ps, s.r, s.score, row_number() OVER (PARTITION BY p.a, positive ORDER BY s.score DESC, s.r) AS place
              FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * ps <= 100 * s.score AND 100 * s.score <= 95 * ps)
        SELECT a AS anchor_id, positive AS positive_id, place::INT AS rank, r AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE place <= 3""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER_AZ}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_line_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, unnest(generate_series(0, len(l) - 3)) AS pos, l FROM d WHERE len(l) >= 3),
        k AS (SELECT doc_id, pos, list_slice(l, pos + 1, pos + 3) AS key FROM w),
        f AS (SELECT key, min({'d': doc_id, 'a': pos}) AS fst, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1),
        s AS (SELECT doc_id, CASE WHEN fst.d = doc_id THEN greatest(pos, fst.a + 3) ELSE pos END AS a, pos + 3 AS b
              FROM k JOIN f USING (key) WHERE NOT (fst.d = doc_id AND fst.a = pos)),
        r AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(generate_series(a, b - 1)) AS x FROM s WHERE a < b) GROUP BY doc_id)
        SELECT t.doc_id, len(string_split(coalesce(t.text, ''), chr(10))) AS n_lines, coalesce(len(gone), 0) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN coalesce(t.text, '') ELSE array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS text_sha256
        FROM documents t LEFT JOIN r USING (doc_id)""",
}
