import random

from skeinrank.llm.line_dedup import line_dedup

from .helpers import SF, crowded, frame


def brute(docs):
    docs = {i: t for i, t in docs}
    first, out = {}, []
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            if key in first:
                d, a = first[key]
                gone |= set(range(max(k, a + 3) if d == i else k, k + 3))
            else:
                first[key] = (i, k)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, None if docs[i] is None else text, len(lines), sorted(gone)))
    return out


def test_random_lines(spark):
    rng = random.Random(6)
    docs = [(i, "\n".join(rng.choice(["a", "b", "", "c c", "é"]) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(100, "a\n" * 30), (101, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.text, r.n_lines, r.removed) for r in line_dedup(df).collect()) == brute(docs)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rows = [(1, "a\nb\nc\nd"), (5, "x\na\nb\nc"), (5, "k\nl\nm\nn"), (5, "k\nl\nm\nn"), (None, "a\nb\nc"), (7, "k\nl\nm\no")]
    got = sorted((r.doc_id or 0, r.text, r.removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, "a\nb\nc\nd", []), (5, "x", [1, 2, 3]), (5, "k\nl\nm\nn", []), (5, "k\nl\nm\nn", []), (0, "a\nb\nc", []), (7, "o", [0, 1, 2])])


def test_many_lines_take_linear_time(spark):
    text = "\n".join(f"line {i}" for i in range(60_000))
    got = line_dedup(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string")).where("doc_id = 2").first()
    assert got.text == "end" and got.n_lines == 60_001


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "id", "at", "key", "removed")
    want = {x[0]: x for x in brute([(r.doc_id, r.text) for r in df.collect()])}
    got = [(r.doc_id, r.text, r.n_lines, r.removed) for r in line_dedup(df).collect()]
    assert len(got) == 13 and all(x == want[x[0]] for x in got)
    assert line_dedup(frame(spark, [])).count() == 0


def test_query(spark):
    from skeinrank.llm.queries import op6_line_dedup

    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in op6_line_dedup(spark, SF).collect()) == [(i, n, len(g)) for i, _, n, g in want]
