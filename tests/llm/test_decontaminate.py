import hashlib
import random
import re

from skeinrank.llm.decontaminate import contamination

from .helpers import SF, crowded, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))):
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def result(df):
    out = []
    for r in df.collect():
        hit = sum(r.spans[i + 1] - r.spans[i] for i in range(0, len(r.spans), 2))
        out.append((r.doc_id, r.n_words, hit, len(r.items), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), hit > 0))
    return sorted(out)


def test_random_texts(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "Ab", "é", "x1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 15, 30, 10, 4, 9, 2, 0, 12])] + [(9, None), (10, text(12))]
    docs = []
    for i in range(120):
        t = text(rng.randint(0, 60))
        if i % 3 == 0:
            own = rng.choice(items)[1] or ""
            t = t + " " + own + " " + (own if i % 6 == 0 else "") + " " + text(3)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(contamination(df, bench)) == brute(docs, items)
    # in shards of a few words, and in several blocks of items; repeated rows stay rows
    monkeypatch.setattr("skeinrank.llm.decontaminate.SHARD_WORDS", 50)
    assert result(contamination(df, bench, block_words=20)) == brute(docs, items)
    kept = contamination(df, bench, block_words=20, keep=("text",))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in docs)
    assert result(kept) == brute(docs, items)


def test_longest_match(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "a b " + " ".join(passage.split()[5:30]) + " c"), (2, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in contamination(df, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert (rows[1].longest, rows[1].spans, rows[1]["items"]) == (25, [2, 27], ["7"])
    assert (rows[2].longest, rows[2].spans) == (0, [])


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "spans", "items", "n_words", "item")
    bench = spark.createDataFrame([(1, "mit license"), (2, "word5 thing5 word6 thing6")], "item_id long, text string")
    assert result(contamination(df, bench)) == brute([(r.doc_id, r.text) for r in df.collect()], [tuple(r) for r in bench.collect()])
    assert {r.n_words for r in contamination(frame(spark, []), bench).collect()} == set()
    assert not any(r.spans for r in contamination(df, bench.limit(0)).collect())


def test_query(spark):
    from skeinrank.llm.queries import op9_decontaminate

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(tuple(r)[:6] for r in op9_decontaminate(spark, SF).collect()) == brute(docs, items)
