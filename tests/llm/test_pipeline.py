import hashlib
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from skeinrank.llm.byte_bpe import codec, read_ranks

from .helpers import SF, frame
from .test_decontaminate import brute as windows
from .test_ngram_join import brute as components

STAGE = dict(corpus_pipeline.STAGES)
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def after_toxicity(rows, items):
    """(id, text) that the stages between toxicity and encoding leave of unique ids."""
    last = {}
    for i, t in sorted(rows):
        last[hashlib.sha256((t or "").encode().translate(LOWER)).digest()] = i, t
    kept = sorted(last.values())
    low = {i: c for i, _, c in components(kept, 5, 4, 5)}
    kept = [(i, t) for i, t in kept if low[i] == i]
    clean = {r[0] for r in windows(kept, items) if not r[5]}
    return [(i, t) for i, t in kept if i in clean]


def test_run_equals_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # the model has no form in brute force: its decisions are read, and held against the labels
    calm = [(r.doc_id, r.text) for r in STAGE["toxicity"](spark, docs, sf).collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.collect()} - {i for i, _ in calm}
    known = [labels[i] for i in gone if i in labels]
    assert sum(known) >= 0.9 * len(known) and sum(known) >= 0.6 * sum(labels.values())
    own = codec(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    want = [(i, own.encode(t), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in after_toxicity(calm, items)]
    got = sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(want) < len(calm)


def staged(spark, name, rows):
    got = STAGE[name](spark, frame(spark, rows), SF)
    return Counter((r.doc_id, r.text) for r in got.collect())


def test_decisions_hold_for_an_id_and_a_text(spark):
    row = lambda i, t: (i, t, "en", "src0", None)
    exact = [row(1, "A"), row(1, "unique"), row(6, "a"), row(2, "again"), row(2, "again"), row(None, None), row(None, ""), row(3, "own"), row(None, "A")]
    assert staged(spark, "exact dedup", exact) in (Counter([(1, "unique"), (6, "a"), (2, "again"), (3, "own"), (None, t)]) for t in (None, ""))
    base = [f"w{i}" for i in range(60)]
    one, two, other = " ".join(base), " ".join(base[:58]), "one two three four five six"
    near = [row(4, one), row(4, other), row(9, two), row(None, one), row(7, other.upper()), row(8, "x y"), row(5, None), row(6, " ")]
    assert staged(spark, "n-gram Jaccard join", near) == Counter([(4, one), (4, other), (8, "x y"), (5, None), (6, " ")])


CLASHING = ["digest", "component", "severity", "spans", "items", "longest", "n_words", "id", "key", "stays", "kept", "keep_id", "cls", "n_shingles", "component_id", "grade", "row", "block", "__text", "__h", "__key", "decoded", "ids", "n_tokens"]


def test_odd_rows_through_all_stages(spark, tmp_path):
    docs = frame(spark)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == frame(spark).columns + CLASHING, name
    kept = {r.doc_id for r in docs.collect()}
    # equal texts leave the largest id, near copies the smallest
    assert kept >= {1, 2, 4, 5, 6, 8, 9, 10} and kept <= {1, 2, 4, 5, 6, 8, 9, 10, 11}
    assert docs.where(" OR ".join(f"`{c}` <> 'clash'" for c in CLASHING)).count() == 0
    assert {r.doc_id for r in STAGE["byte-level BPE"](spark, docs, SF).collect()} == kept


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs, SF).count() == 0
