import math
import re

from skeinrank.llm.license_scan import PHRASES, SPREAD, TEMPLATES, license_blocks, license_scan
from skeinrank.llm.queries import op5_license_scan

from .helpers import SF, crowded, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def base(text):
    w, at, labels = words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), labels


def paragraphs(text):
    """Runs of words that no line without words parts."""
    run = []
    for line in (text or "").split("\n"):
        own = words(line)
        if not own and run:
            yield run
            run = []
        run = run + own
    if run:
        yield run


def blocks(docs, templates=TEMPLATES, threshold=0.9):
    """(id, label, template): all runs of words of any place, against all templates."""
    out = set()
    for i, text in docs:
        for run in paragraphs(text):
            for label, ts in templates.items():
                for t in ts:
                    need, room = set(words(t)), math.ceil(SPREAD * len(words(t)))
                    if any(len(need.intersection(run[s : s + room])) >= math.ceil(threshold * len(need) - 1e-9) for s in range(len(run)) if need):
                        out.add((i, label, t))
    return out


def brute(docs):
    found = blocks(docs)
    return sorted(((i, *base(t)[:4], ",".join(sorted(base(t)[4])), ",".join(sorted(base(t)[4] | {x[1] for x in found if x[0] == i}))) for i, t in docs), key=repr)


TEXTS = [
    "MIT license MIT License mit-license", "CC BY cc by CC-BY", "GNU General Public License; Apache License", "the permit license", "MİT lİcense cc by", "mit\nlicense",
    "x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 now", "CC\x7fBY \x00mit\x1flicense",
    "before\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of this software\n# and associated documentation files\n\nafter", "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy of this software and associated",
    "Permission is hereby\n granted, free\n * of charge, to\n * any person\n * obtaining a copy\n * of this software\n * and associated\n documentation files", "Licensed under CC\nBY-NC 4.0", "Licensed\nunder\nCC\nBY-NC\n4.0", "Licensed\n\nunder CC BY-NC 4.0",
    "Licensed under a deal of many other words that go on and on, CC BY-SA 4.0", "x " * 3000 + "Released under the MIT License" + " y" * 3000,
    "Redistribution and use in source and binary forms, with modification, are permitted provided that the following conditions are met",
]


def test_phrases_and_templates(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base), ",".join(r.labels)) for r in license_scan(df).collect()), key=repr)
    assert got == brute(docs)


def test_containment_thresholds(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(14)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    templates = {"a": [line(5), line(8)], "b": [line(3), "", line(12)]}
    docs = [(i, "\n".join(line(rng.randint(0, 16)) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.5, 0.75, 1.0):
        got = {(r.id, r.label, r.template) for r in license_blocks(df, templates, threshold).collect()}
        assert got == blocks(docs, templates, threshold)


def test_null_and_repeated_ids(spark):
    mit = "Released under the MIT License"
    rows = [(1, mit), (1, "nothing"), (None, "Licensed under CC BY-NC 4.0"), (None, "x"), (1, mit), (2, None)]
    got = sorted((str(r.doc_id), r.n_words, ",".join(r.labels)) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [("1", 1, ""), ("1", 5, "mit"), ("1", 5, "mit"), ("2", 0, ""), ("None", 1, ""), ("None", 7, "cc-by,cc-by-nc")]


def test_odd_rows_and_empty(spark):
    df = crowded(frame(spark), "words", "id", "label", "n_words")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base), ",".join(r.labels)) for r in license_scan(df).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert license_scan(frame(spark, [])).count() == 0


def test_query_is_native(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = op5_license_scan(spark, SF)
    assert sorted((tuple(r)[:7] for r in df.collect()), key=repr) == brute(docs)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
