"""The hits of all ten strategies over documents that are chunks, in three passes: what `retrieve.STRATEGIES` give one by one, with
their stand-ins (`ports.HashedTerms`, the analyzer `text.terms`, `chunking.salient`, `raptor` over lines, `EntityGraph.local`).

The first pass cuts every text into words once. From them come the vectors of the document, its lines, its summaries and
what goes before it, which are compared where they are made, and its terms, the only thing of the corpus that is stored. The second
counts terms and the neighbours of those asked for, the third scores. Of a ranking only each task's k best are shuffled. No
communities are made, as no strategy asks for them.

A word is told from its neighbours by itself, so that stems and buckets are looked up by word, and a text's vector is the sum of its sentences'.
Texts with `ODD` letters, for which two libraries may differ, come with terms and sentences made by Spark and are embedded as wholes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ports
from ..functions import text as tx
from ..sources.readers import stored
from . import chunking, retrieve
from .graph import NEAR, UNIT, _presence
from .retrieve import POOL, QUERY_BLOCK, ROWS, SCORES, fuse, rerank, to_parents

#: Letters beyond those whose lower case and class no Unicode version differs in; documents and words taken at a time, and words remembered.
ODD = r"[\u0130\u0250-\u1FFF\u2070-\u209F\u20C0-\x{10FFFF}]"
DOCS, WORDS, MEMO, GROUP, LEVELS = 400, 4_000_000, 200_000, 5, 5
#: `ports.WORD` where no `ODD` letters are.
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"([.!?])[ \t]+")
ACCENTS = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
STEM = re.compile(tx.stem_pattern(), re.DOTALL)
STOP = frozenset(tx.STOP_WORDS)
BY_DOCUMENT, BY_NAME = ("chunks", "contextual", "summarized", "both"), ("fragments", "nodes")


def term_of(word: str) -> str | None:
    """The analyzer's term of a word in lower case; none of a stop word."""
    plain = word if word.isascii() else word.translate(ACCENTS)
    if plain in STOP:
        return None
    found = STEM.match(plain)
    return found[1] if found else plain


class _Memo(dict):
    """The number of each word seen, and by number its bucket and its term's place in `terms`; -1 is none."""

    def __init__(self, model):
        self.model, self.bucket, self.term, self.terms, self.place = model, [], [], [], {}

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.bucket)
        self.bucket.append(self.model.place[word])
        term = term_of(word)
        if term is not None and term not in self.place:
            self.place[term] = len(self.terms)
            self.terms.append(term)
        self.term.append(-1 if term is None else self.place[term])
        return at


class _Nearest:
    """The k best of each question among the vectors seen, as `retrieve.dense` ranks them; a name is made only of what may be among them."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.least = q, k, np.full(len(q), -np.inf)
        self.row, self.name, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, v: np.ndarray, names) -> None:
        if not len(v):
            return
        own = self.q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
        least = self.least
        if np.isinf(least).any() and len(v) > self.k:
            least = np.maximum(least, np.partition(own, len(v) - self.k, axis=1)[:, len(v) - self.k])
        # what is further below than a rounding step comes after k others
        row, column = np.nonzero(own >= (least - 2e-6)[:, None])
        if not len(row):
            return
        used, at = np.unique(column, return_inverse=True)
        name = np.array(names(used))[at]
        row, score = np.concatenate((self.row, row)), np.concatenate((self.score, np.round(own[row, column], 6) + 0.0))
        name = name if self.name is None else np.concatenate((self.name, name))
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.name, self.score = row[kept], name[kept], score[kept]
        counts = np.bincount(self.row, minlength=len(self.q))
        last = np.cumsum(counts) - 1
        self.least = np.where(counts == self.k, self.score[np.maximum(last, 0)], -np.inf)


def _best_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each group the place of the largest number, the first of several."""
    n = len(words)
    return n - 1 - np.maximum.reduceat(words.astype(np.int64) * n + (n - 1 - np.arange(n)), starts) % n


def _scan(batches, asked: tuple, model, k: int, pool: int):
    """What a task of the first pass does; see `analysed`."""
    questions, q, kind = asked
    best = {name: _Nearest(q, max(pool, k) if name == "chunks" else k) for name in BY_DOCUMENT + BY_NAME}
    memo, contexts = _Memo(model), {}
    for batch in batches:
        for lo in range(0, len(batch), DOCS):
            part = batch.slice(lo, DOCS)
            if len(memo) > MEMO:
                memo = _Memo(model)
            yield _slice(part, model, memo, contexts, best)
    for name, b in best.items():
        if b.name is not None:
            by_name = name in BY_NAME
            ids = pa.array(b.name.tolist(), pa.string() if by_name else pa.int64())
            none = lambda t: pa.nulls(len(b.row), t)  # noqa: B023, E731
            yield _rows(pa.array([name] * len(b.row)), none(pa.int64()) if by_name else ids, pa.array([questions[i] for i in b.row], kind), ids if by_name else none(pa.string()), pa.array(b.score), none(pa.string()), none(pa.int32()), none(pa.list_(pa.string())))


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["kind", "doc_id", "question_id", "name", "score", "content", "ahead", "words"])


def _slice(part: pa.RecordBatch, model, memo: _Memo, contexts: dict, best: dict) -> pa.RecordBatch:
    """Some documents compared with all questions; a row of terms for each of them."""
    d, (ids, sources, ahead, texts, leads, sizes, given) = model.dimensions, (part[c].to_pylist() for c in ("doc_id", "source", "context", "text", "leads", "sizes", "terms"))
    n = len(ids)
    words, per_sentence, per_line, per_doc, line_texts = [], [], [], [], []
    before, before_terms = np.zeros((n, d)), part["before"].to_pylist()
    for i, text in enumerate(texts):
        if ahead[i] not in contexts:
            if len(contexts) > 10_000:
                contexts.clear()
            own = before_terms[i]
            contexts[ahead[i]] = model.embed([ahead[i]])[0], [t for w in WORD.findall(ahead[i].lower()) if (t := term_of(w)) is not None] if own is None else own
        before[i], before_terms[i] = contexts[ahead[i]]
        lines = (text or "").split("\n")
        per_doc.append(len(lines))
        line_texts += lines
        if leads[i] is not None:  # embedded as wholes below
            per_line += [1] * len(lines)
            per_sentence += [0] * len(lines)
            continue
        for line in lines:
            sentences = SENTENCE_END.sub("\\1\n", line).split("\n")
            per_line.append(len(sentences))
            for s in sentences:
                own = WORD.findall(s.lower())
                per_sentence.append(len(own))
                words += own
    code = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    bucket, term = np.array(memo.bucket, np.int64)[code] if len(code) else code, np.array(memo.term, np.int64)[code] if len(code) else code
    per_sentence, per_line, per_doc = (np.array(x, np.int64) for x in (per_sentence, per_line, per_doc))
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    line_of = np.repeat(np.arange(len(per_line)), per_line)
    doc_of = np.repeat(np.arange(n), per_doc)
    starts = lambda sizes: np.concatenate(([0], np.cumsum(sizes)[:-1]))
    vectors = lambda at, own, many: np.bincount(at * d + own, minlength=many * d).reshape(many, d).astype(float)
    line_at = line_of[sentence]
    lines = vectors(line_at, bucket, len(per_line))
    # of each line the sentence with most distinct words
    different = np.bincount(np.unique(sentence * max(1, len(memo.bucket)) + code) // max(1, len(memo.bucket)), minlength=len(per_sentence))
    chosen = _best_of(different, starts(per_line))
    in_lead = np.zeros(len(per_sentence), bool)
    in_lead[chosen] = True
    held = in_lead[sentence]
    lead, size = vectors(line_at[held], bucket[held], len(per_line)), different[chosen]
    first = starts(per_doc)
    docs = np.add.reduceat(lines, first)
    for i in range(n):
        if leads[i] is not None:
            a, b = first[i], first[i] + per_doc[i]
            lines[a:b], lead[a:b], size[a:b] = model.embed(line_texts[a:b]), model.embed(leads[i]), sizes[i]
            docs[i] = model.embed([texts[i]])[0]
    top = lead[_best_of(size, first)]
    number = np.array(ids)
    for name, v in (("chunks", docs), ("contextual", before + docs), ("summarized", top + docs), ("both", top + before + docs)):
        best[name].add(v, lambda at: number[at])
    # fragments: every document, and of long ones the lines that aren't blank
    parent = ["::".join(([] if s is None else [s]) + [f"doc-{i}"]) for s, i in zip(sources, ids)]
    best["fragments"].add(docs, lambda at: [parent[i] for i in at])
    long_ = np.array([len(t or "") > chunking.LIMIT for t in texts])
    parts = np.flatnonzero(long_[doc_of])
    parts = parts[[line_texts[i].strip(" ") != "" for i in parts]] if len(parts) else parts
    best["fragments"].add(lines[parts], lambda at: [f"{parent[doc_of[i]]}::par-{i - first[doc_of[i]] + 1}" for i in parts[at]])
    # the tree: its leaves are the lines, a node of the next level five neighbours' sentences
    some = np.flatnonzero(np.array([t is not None for t in texts])[doc_of])
    owner, at_place = doc_of[some], (np.arange(len(doc_of)) - first[doc_of])[some]
    best["nodes"].add(lines[some], lambda at: [f"{ids[o]}::{p}" for o, p in zip(owner[at].tolist(), at_place[at].tolist())])
    v, size = lead[some], size[some]
    for level in range(1, LEVELS + 1):
        on = np.bincount(owner, minlength=n)[owner] > 1
        owner, at_place, v, size = owner[on], at_place[on], v[on], size[on]
        if not len(owner):
            break
        begin = np.flatnonzero(at_place % GROUP == 0)
        whole, chosen = np.add.reduceat(v, begin), _best_of(size, begin)
        owner, at_place, v, size = owner[begin], at_place[begin] // GROUP, v[chosen], size[chosen]
        best["nodes"].add(whole, lambda at, level=level, owner=owner, at_place=at_place: [f"summary::{ids[o]}::{level}::{p}" for o, p in zip(owner[at].tolist(), at_place[at].tolist())])
    return _terms_row(part, memo, term, doc_of[line_at], given, before_terms)


def _terms_row(part, memo, term, doc_at, given, ahead) -> pa.RecordBatch:
    """A row a document: the terms of what goes before it (`ahead` of them), then its own."""
    n, known = len(part), term >= 0
    own = pa.array(memo.terms, pa.string()).take(pa.array(term[known])) if known.any() else pa.array([], pa.string())
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc_at[known], minlength=n))))
    pieces, sizes = [], [0]
    for i, (b, g) in enumerate(zip(ahead, given)):
        body = pa.array(g, pa.string()) if g is not None else own.slice(ends[i], ends[i + 1] - ends[i])
        pieces += [pa.array(b, pa.string()), body]
        sizes.append(len(b) + len(body))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.concat_arrays(pieces))
    none = lambda t: pa.nulls(n, t)
    return _rows(pa.array(["words"] * n), part["doc_id"], none(part.schema.field("asked").type), none(pa.string()), none(pa.float64()), part["content"], pa.array([len(b) for b in ahead], pa.int32()), lists)


def analysed(docs: DataFrame, questions: DataFrame, k: int, model) -> DataFrame:
    """docs(doc_id, source, lang, text): rows of kind `words` (doc_id, content, ahead, words), and of each kind of text each task's
    best (question_id, doc_id or name, score)."""
    rows = retrieve.embedded(questions, model, "question_id").toArrow()
    q = np.array(rows["embedding"].to_pylist(), float).reshape(len(rows), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    kind = rows.schema.field("question_id").type
    shared = docs.sparkSession.sparkContext.broadcast((rows["question_id"].to_pylist(), q, kind))
    odd, context = F.col("text").rlike(ODD), F.concat_ws(" ", "source", "lang")
    leads = F.transform(F.split("text", "\n"), chunking.salient)
    names = questions.schema["question_id"].dataType.simpleString()
    given = docs.select(
        "doc_id", "source", "lang", "text", F.when(odd, leads).alias("leads"), F.when(odd, F.transform(leads, lambda s: F.size(F.array_distinct(tx.tokens(s))))).alias("sizes"), F.when(odd, tx.terms(F.col("text"))).alias("terms"),
        context.alias("context"), F.when(context.rlike(ODD), tx.terms(context)).alias("before"), F.sha2(F.trim("text"), 256).alias("content"), F.lit(None).cast(names).alias("asked"),
    )
    schema = f"kind string, doc_id long, question_id {names}, name string, score double, content string, ahead int, words array<string>"
    return given.mapInArrow(lambda batches: _scan(batches, shared.value, model, k, POOL), schema)


# ---------------------------------------------------------------- the second pass: counts

#: Codes of what a term is counted for, beside the numbers of terms asked for, next to which it stands. CONTEXTUAL_TERMS is the least.
IN_CONTENTS, IN_CHUNKS, IN_CONTEXTUAL, CHUNKS, CHUNK_TERMS, CONTEXTUAL, CONTEXTUAL_TERMS = range(-1, -8, -1)
#: Of each term its degree, and its count n by code.


def _coded(part: pa.RecordBatch):
    """(terms, number of each term of all rows, its row, whether it is the document's own and not of what goes before it)."""
    lists = part["words"]
    coded = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(part)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, np.arange(len(row)) - begin[row] >= part["ahead"].to_numpy()[row]


def _contents(part: pa.RecordBatch) -> np.ndarray:
    """Which rows stand for a text in the graph."""
    return part["content"].is_valid().to_numpy(zero_copy_only=False) & ~part["copy"].to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch, most: int):
    """Slices of a batch with `most` terms, one row at least."""
    ends = np.cumsum(batch["words"].value_lengths().to_numpy())
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


COUNTS = "term string, degree long, codes array<int>, ns array<long>"


def _counts(term, degree, ends, codes, ns) -> pa.RecordBatch:
    ends = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((codes, pa.int32()), (ns, pa.int64()))]
    return pa.RecordBatch.from_arrays([term, pa.array(degree, pa.int64()), *lists], ["term", "degree", "codes", "ns"])


def _count(batches, terms: dict):
    """Rows of COUNTS of a task's texts, added up by WORDS terms: one a term, and one for each number of rows."""
    many = max(1, len(terms))
    names = pa.array(sorted(terms, key=terms.get), pa.string())
    for batch in batches:
        for part in _parts(batch, WORDS):
            found, code, row, own = _coded(part)
            asked = np.array([terms.get(t, -1) for t in found.to_pylist()] or [-1], np.int64)
            text = part["content"].is_valid().to_numpy(zero_copy_only=False)
            known, content = asked[code] >= 0, own & _contents(part)[row]
            # in how many rows each term asked for is
            for which, kind in ((own, IN_CHUNKS), (own | True, IN_CONTEXTUAL), (content, IN_CONTENTS)):
                n = np.bincount(np.unique(row[which & known] * many + asked[code[which & known]]) % many, minlength=many)
                held = np.flatnonzero(n)
                yield _counts(names.take(pa.array(held)), np.zeros(len(held), np.int64), np.arange(len(held) + 1), np.full(len(held), kind), n[held])
            yield _counts(pa.array([""]), [0], [0, 4], [CHUNKS, CHUNK_TERMS, CONTEXTUAL, CONTEXTUAL_TERMS], [text.sum(), own.sum(), len(part), len(own)])
            # neighbours in a content, both ways
            next_ = np.flatnonzero(content[:-1] & content[1:] & (row[:-1] == row[1:]) & (code[:-1] != code[1:]))
            x, y = np.concatenate((code[next_], code[next_ + 1])), np.concatenate((code[next_ + 1], code[next_]))
            degree = np.bincount(x, minlength=len(found))
            pair, n = np.unique(x[asked[y] >= 0] * many + asked[y[asked[y] >= 0]], return_counts=True)
            held = np.flatnonzero(degree)
            ends = np.searchsorted(pair, np.append(held, len(found)) * many)  # a term without degree has no pair
            yield _counts(found.take(pa.array(held)), degree[held], ends, pair % many, n)


def _merge(batches, many: int):
    """Rows of COUNTS that are sorted by term, added up by term; what stands next to no term asked for goes."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        run = rows[0]["term"].dictionary_encode().indices.to_numpy()
        last = int(np.searchsorted(run, run[-1]))
        yield from _merged(rows[0].slice(0, last), many)
        rest = rows[0].slice(last)
    if rest is not None:
        yield from _merged(rest, many)


def _merged(rows: pa.RecordBatch, many: int):
    if not len(rows):
        return
    coded = rows["term"].dictionary_encode()
    run = coded.indices.to_numpy().astype(np.int64)
    degree = np.add.reduceat(rows["degree"].to_numpy(), np.searchsorted(run, np.arange(len(coded.dictionary))))
    wide = many - CONTEXTUAL_TERMS
    key = np.repeat(run, rows["codes"].value_lengths().to_numpy()) * wide + (rows["codes"].flatten().to_numpy().astype(np.int64) - CONTEXTUAL_TERMS)
    key, at = np.unique(key, return_inverse=True)
    n = np.bincount(at, rows["ns"].flatten().to_numpy(), len(key)).astype(np.int64)  # whole numbers: exact below 2**53
    held = np.unique(key // wide)
    ends = np.searchsorted(key, np.append(held, len(degree)) * wide)
    yield _counts(coded.dictionary.take(pa.array(held)), degree[held], ends, key % wide + CONTEXTUAL_TERMS, n)


def counted(words: DataFrame, terms: list[str]) -> DataFrame:
    """words(content, ahead, words, copy): COUNTS of each term that stands next to one asked for, or is one."""
    shared = words.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    counts = words.select("content", "ahead", "words", "copy").mapInArrow(lambda batches: _count(batches, shared.value), COUNTS)
    many = max(1, len(terms))
    return counts.repartition("term").sortWithinPartitions("term").mapInArrow(lambda batches: _merge(batches, many), COUNTS)


# ---------------------------------------------------------------- the third pass: scores


def _score(batches, asked: dict, kinds: dict, kind: pa.DataType):
    """Each task's best of a question by kind: (kind, question_id, chunk_id, score). asked: by kind what `retrieve.by_term`
    gives; kinds: k, value, digits."""
    kept = {name: retrieve._Kept(k) for name, (k, _, _) in kinds.items()}
    place = {name: {t: i for i, t in enumerate(shared[0].tolist())} for name, shared in asked.items()}
    step = max(1, min(ROWS, SCORES // max(1, *(len(shared[1]) for shared in asked.values()))))
    for batch in batches:
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            found, code, row, own = _coded(part)
            found, ids = found.to_pylist(), part["doc_id"].to_numpy()
            which = {"chunks": own, "contextual": own | True, "contents": own & _contents(part)[row]}
            for name, (k, value, digits) in kinds.items():
                term = np.array([place[name].get(t, -1) for t in found] or [-1], np.int64)[code]
                length, known = np.bincount(row[which[name]], minlength=len(part)), which[name] & (term >= 0)
                for best in retrieve.products(row[known], term[known], length, ids, asked[name], k, value, digits):
                    kept[name].add(best)
    for name, own in kept.items():
        for out in own.batches(kind, pa.int64()):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), *out.columns], ["kind", *out.schema.names])


def _strongest(batches, degrees: np.ndarray, near: int):
    """A task's `near` strongest neighbours of each term asked for: (code, term, strength)."""
    code, name, strength, least = np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0, np.int64), np.ones(len(degrees), np.int64)
    for batch in batches:
        row = np.repeat(np.arange(len(batch)), batch["codes"].value_lengths().to_numpy())
        own, n = batch["codes"].flatten().to_numpy().astype(np.int64), batch["ns"].flatten().to_numpy()
        row, own, n = row[own >= 0], own[own >= 0], n[own >= 0]
        value = n * UNIT // (degrees[own] * batch["degree"].to_numpy()[row])
        good = np.flatnonzero(value >= least[own])
        if not len(good):
            continue
        used, at = np.unique(row[good], return_inverse=True)
        names = np.array(batch["term"].take(pa.array(used)).to_pylist())[at]
        code, name, strength = np.concatenate((code, own[good])), np.concatenate((name, names)), np.concatenate((strength, value[good]))
        order = np.lexsort((name, -strength, code))
        code, name, strength = code[order], name[order], strength[order]
        place = np.arange(len(code)) - np.searchsorted(code, code)
        least[code[place == near - 1]] = strength[place == near - 1]
        code, name, strength = code[place < near], name[place < near], strength[place < near]
    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(name.tolist(), pa.string()), pa.array(strength, pa.int64())], ["code", "term", "strength"])


def _followed(counts: DataFrame, degrees: np.ndarray, near: int = NEAR) -> DataFrame:
    """(code, i, term): the strongest neighbours of each term asked for, in order; degrees: of the terms asked for."""
    shared = counts.sparkSession.sparkContext.broadcast(degrees)
    pairs = counts.mapInArrow(lambda batches: _strongest(batches, shared.value, near), "code int, term string, strength long")
    place = F.row_number().over(W.partitionBy("code").orderBy(F.desc("strength"), "term"))
    return pairs.withColumn("i", place).where(F.col("i") <= near).select("code", "i", "term")


def scored(words: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Each task's best of a question over `words`: BM25 over texts (`chunks`) and with what goes before them (`contextual`), and by
    entities and their neighbours (`contents`)."""
    asked = questions.select("question_id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times")).orderBy("question_id", "term").toPandas()
    terms = sorted(asked["term"].unique().tolist())
    counts = stored(counted(words, terms), "counts")
    own = counts.where(F.array_min("codes") < 0).select("term", "degree", F.explode(F.arrays_zip("codes", "ns")).alias("p")).select("term", "degree", F.col("p.codes").alias("code"), F.col("p.ns").alias("n")).where("code < 0").toPandas()
    of = {c: dict(zip(own["term"][own["code"] == c], own["n"][own["code"] == c])) for c in range(CONTEXTUAL_TERMS, 0)}
    kinds, tables = {}, {}
    for name, depth, df, n, total in (("chunks", max(POOL, k), IN_CHUNKS, CHUNKS, CHUNK_TERMS), ("contextual", k, IN_CONTEXTUAL, CONTEXTUAL, CONTEXTUAL_TERMS)):
        held = asked["term"].map(of[df]).fillna(0).to_numpy(float)
        worth, depth, value = retrieve.weighed(asked, held, of[n].get("", 0), of[total].get("", 0), depth)
        tables[name], kinds[name] = retrieve.by_term(worth), (depth, value, 6)
    # entities asked for, and the neighbours of each
    direct = asked[["question_id", "term"]].assign(w=1.0 / asked["term"].map(of[IN_CONTENTS]).to_numpy(float)).dropna(subset=["w"])
    degree = dict(zip(own["term"], own["degree"]))
    followed = _followed(counts, np.array([degree.get(t, 0) for t in terms], np.int64)).toPandas()
    beyond = direct.rename(columns={"term": "of"}).merge(followed.assign(of=[terms[c] for c in followed["code"]]), on="of")
    beyond = beyond.assign(w=0.5 * beyond["w"] / beyond["i"])[["question_id", "term", "w"]]
    weights = pd.concat([direct, beyond]).groupby(["question_id", "term"], as_index=False)["w"].sum()
    tables["contents"], kinds["contents"] = retrieve.by_term(weights), (k, _presence, 9)
    kind = retrieve.question_hits(questions, words.withColumnRenamed("doc_id", "chunk_id"))
    arrow = questions.select("question_id").limit(1).toArrow().schema.field("question_id").type
    shared = words.sparkSession.sparkContext.broadcast(tables)
    return words.mapInArrow(lambda batches: _score(batches, shared.value, kinds, arrow), f"kind string, {kind}")


# ---------------------------------------------------------------- the ten strategies


def fits(docs: DataFrame, questions: DataFrame) -> bool:
    """Whether ids are whole numbers that aren't repeated, and one broadcast holds the questions. Else each strategy goes by itself."""
    if docs.schema["doc_id"].dataType.simpleString() != "bigint" or questions.count() > QUERY_BLOCK:
        return False
    return docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()


def _rankings(found: DataFrame, k: int):
    """A ranking of each kind, by (question_id, doc_id or name)."""
    order = W.partitionBy("kind", "question_id").orderBy(F.desc("score"), "doc_id", "name")
    best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(POOL, k)), "best")
    return lambda kind, depth=k, chunk="doc_id": best.where((F.col("kind") == kind) & (F.col("rank") <= depth)).select("question_id", "rank", F.col(chunk).alias("chunk_id"), "score")


def hits(docs: DataFrame, questions: DataFrame, k: int, model: ports.HashedTerms) -> DataFrame:
    """docs(doc_id, source, lang, text), questions(question_id, text): (strategy, question_id, rank, chunk_id, score) of all strategies."""
    found = stored(analysed(docs, questions, k, model), "analysed")
    near = _rankings(found.where("kind <> 'words'").select("kind", "question_id", "doc_id", "name", "score"), k)
    words = found.where("kind = 'words'").select("doc_id", "content", "ahead", "words")
    # of equal texts the last one stands for all in the graph; they are told by narrow rows
    last = W.partitionBy("content").orderBy(F.desc("doc_id"))
    copies = stored(words.where("content IS NOT NULL").select("content", "doc_id").withColumn("i", F.row_number().over(last)).where("i > 1").select("doc_id", F.lit(True).alias("copy")), "copies")
    words = words.join(copies, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    by_terms = scored(words, questions, k).select("kind", "question_id", F.col("chunk_id").alias("doc_id"), F.lit(None).cast("string").alias("name"), "score")
    sparse = _rankings(by_terms, k)
    pool = max(POOL, k)
    both = stored(fuse(near("chunks", pool), sparse("chunks", pool), pool), "pool")
    # only texts of the pool are moved
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text").join(both.select("chunk_id").distinct(), "chunk_id", "left_semi")
    fragments = near("fragments", chunk="name")
    parents = fragments.select("chunk_id", F.regexp_replace("chunk_id", "::par-[0-9]+$", "").alias("parent_id")).distinct()
    made = {
        "dense": near("chunks"),
        "sparse_bm25": sparse("chunks"),
        "hybrid_rrf": fuse(near("chunks"), sparse("chunks"), k),
        "reranked": rerank(both, questions, chunks, k),
        "contextual": fuse(near("contextual"), sparse("contextual"), k),
        "parent_child": to_parents(fragments, parents),
        "sac": near("summarized"),
        "sac_contextual": near("both"),
        "raptor": near("nodes", chunk="name"),
        "graphrag": sparse("contents").withColumn("score", 1.0 / F.col("rank")),
    }
    out = None
    for label in retrieve.STRATEGIES:
        own = made[label].select(F.lit(label).alias("strategy"), "question_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "score")
        out = own if out is None else out.unionByName(own)
    return out
