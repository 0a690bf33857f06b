"""The scorecard's hits in three passes against each strategy by itself."""

import itertools

from pyspark.sql import functions as F

from skeinrank import ports
from skeinrank.functions import text as tx
from skeinrank.operators import together
from skeinrank.operators.graph import EntityGraph
from skeinrank.plans import queries as Q

TEXTS = [
    "The fee is due. A late fee is doubled!  Nobody pays twice? No", "", None, " ", "\n\n", "Ações e decisões: não há prazo.\nOs prazos são de 30 dias. A taxa é paga", "ΟΔΟΣ. Ο ΝΟΜΟΣ της οδού.\nfee ΟΔΟΣ",
    "İstanbul fee. i̇stanbul Fee", "the fee is due. a late fee is doubled!  nobody pays twice? no", "Ações e decisões: não há prazo.\nOs prazos são de 30 dias. A taxa é paga", "  Ações e decisões: não há prazo.\nOs prazos são de 30 dias. A taxa é paga  ",
    "\n".join(f"Line {i} of the fee number {i % 7}. \tTax {i * i} is due, prazo {i % 3}.\r" + ("" if i % 9 else "\n \n\t") for i in range(160)), "x" * 1801, "漢字 漢字. 仮名 fee", "½ ² ª º prazo_taxa fee’s “tax” – due", "prazos prazo prazo taxas taxa taxa fee",
]
ASKED = ["late fee doubled", "prazos e taxas", "ΟΔΟΣ οδού", "", None, "number 3 tax 49", "istanbul", "the fee is due"]


def _tables(spark, folder):
    docs = [(i * 3, t, ["en", "pt", None][i % 3], ["src1", None, "law a"][i % 4 % 3], 0) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_all_strategies_together_give_what_each_gives(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    monkeypatch.setattr(together, "DOCS", 5)
    monkeypatch.setattr(together, "WORDS", 300)
    got = {tuple(r) for r in Q._all_hits(spark, sf).collect()}
    # no strategy asks for communities
    assert not EntityGraph(spark, Q._kept(spark, sf, "chunks", "graph")).built()
    assert got == {tuple(r) for r in Q._each_hits(spark, sf).collect()}
    assert len({r[0] for r in got}) == 10


def test_repeated_ids_go_the_long_way(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert together.fits(docs, docs) and not together.fits(docs.unionByName(docs), docs)
    assert not together.fits(docs.withColumn("doc_id", F.col("doc_id").cast("string")), docs)


def test_a_words_term_is_the_analyzers(spark):
    words = ["".join(w) + s for w in itertools.product("aá1", "bs", "oõ", "se") for s in ["", *tx.SUFFIXES, "adosar", "ºs"]] + tx.STOP_WORDS + ["são", "até", "às", "nãos", "ações", "decisões"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.terms(F.col("w")).alias("t")).collect()
    assert [(r.w, r.t) for r in rows] == [(r.w, [t for t in [together.term_of(r.w)] if t is not None]) for r in rows]
    plain = [chr(c) for c in [*range(0x130), *range(0x131, 0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]]
    assert [c for c in plain if bool(together.WORD.fullmatch(c)) != bool(ports.WORD.fullmatch(c))] == []
