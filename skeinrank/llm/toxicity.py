"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector, shared by the ordered
thresholds. The features are words and beginnings of words (of 3 to 8 bytes, as a language
builds many words on one stem). A feature's value is the log of how often the text holds it
over how often a clean text of its length would: once in a long text may be chance.

Candidates are taken for each language by itself: those that stand densely in texts of higher
grades more often than chance (a signed root of the likelihood ratio over one of `MIN_Z`, the one that does best held out), but for
those whose texts another one of another length, chosen before, holds already (so one stem
stands for its words). None has to be certain by itself: an L2 penalty keeps weak ones small. The text's
expected severity is the mean grade.

The severity from which a text is rejected, `reject`, is set on rows that were held out: the
sample is dealt into `FOLDS`, each scored by a model whose features and weights come from the
others, and the lowest cut is taken at which `PRECISION` of the rejected are bad.
`held_out` says how many of each language were caught at it.

Grades are what raters gave: any integer expression over the labels' columns, never over the
texts; those of `bad_from` and beyond are bad. There is a threshold for each step between grades.

The fit takes a bounded sample (`max_rows` labelled rows, about, by a hash of the id), of whose
near copies only one is used. The sample is kept on the executors' disks while it is fitted;
one that is lost is made again. Every text is scored whole. Nothing is shuffled when scoring;
the model is some kilobytes.

Edge cases: a null or empty text has no features and gets the severity of a text without any;
rows that repeat score alike; labels of unknown documents, null and negative grades and repeated labels (the
highest counts) do no harm; with fewer than two grades, or no cut of that precision, none is
rejected; other columns are carried only when asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM_WORDS, beginnings, let_go, lowered, mix64, sized_words, sliced, text_buffer, words

#: Labelled rows to fit on (about); how far from chance a candidate must be (the bar that does best on held-out rows counts); texts it must stand in.
MAX_ROWS, MIN_Z, MIN_TEXTS = 8_000, (2.8, 3.5, 4.5, 6.0), 2
#: L2 penalty of one weight against the whole sample's likelihood.
PENALTY = 1.0
#: The share of a feature's texts from which another one stands for it; words among which one makes it stand densely.
COVERED, DENSE = 0.95, 250
#: Added to what is found and to what chance would give.
EXPECTED = 0.1
#: Parts of the sample, each held out once; the share of higher grades among the rejected of them.
FOLDS, PRECISION = 5, 0.97
#: Candidates of a language that are looked at closely, and the longest beginning of a word.
CANDIDATES, BEGINNING = 300, 8
#: Hash functions by which near copies in the sample are told.
COPY_HASHES = 6


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """Ordered thresholds and shared weights; `features` are sorted word hashes, `chance` how often a clean text's word is one.

    `reject` is the severity from which a text is rejected; `held_out`: (language, texts, bad ones, caught, wrongly rejected).
    """

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, chance: np.ndarray | None = None, reject: float = float("inf"), held_out: tuple = ()):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self.chance = np.zeros(len(features)) if chance is None else chance
        self.reject, self.held_out = reject, held_out

    def severity(self, x: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of the probability to be beyond."""
        z = x @ self.weights if len(self.weights) else np.zeros(len(x))
        return sum((_sigmoid(z - t) for t in self.thresholds), np.zeros(len(x)))

    def rows(self, column: pa.Array) -> np.ndarray:
        """The features' values in each text."""
        out = [_values(*_counts(part, self.features), self.chance) for part in _pieces(column)]
        return np.concatenate(out) if out else np.zeros((0, len(self.features)))


def _values(counts: np.ndarray, n_words: np.ndarray, chance: np.ndarray) -> np.ndarray:
    return np.maximum(np.log(counts + EXPECTED) - np.log(n_words[:, None] * chance + EXPECTED), 0)


def _counts(column: pa.Array, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each text holds each of the sorted names, and its number of words."""
    bounds, found = _occurrences(column)
    out = np.zeros((len(bounds) - 1, len(names)))
    if len(names):
        for word, h in found:
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            hit = np.flatnonzero(names[at] == h)
            np.add.at(out, (np.searchsorted(bounds, word[hit], "right") - 1, at[hit]), 1)
    return out, np.diff(bounds)


def _pieces(column: pa.Array):
    """Runs of neighbouring texts of 256 KB together, or one larger text."""
    _, off = text_buffer(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 18), "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def _occurrences(column: pa.Array):
    """Row bounds in words, and (words, feature names) by kind; a name's low four bits are its length, 15 for a whole word."""
    buf, off = text_buffer(column)
    buf = lowered(buf)
    starts, h, bounds, sizes = sized_words(buf, off, ALNUM_WORDS)
    name = lambda x, n: (x & ~np.uint64(15)) | np.uint64(n)
    found = [(np.arange(len(h)), name(h, 15))]
    found += [(at, name(x, n)) for n, at, x in beginnings(buf, starts, sizes, BEGINNING) if n >= 3]
    return bounds, found


def fit_ordinal(x: np.ndarray, grade: np.ndarray, levels: int, steps: int = 800, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent with step halving; thresholds stay ordered as sums of positive gaps."""
    n, d = x.shape
    share = np.clip([(grade <= k).mean() for k in range(levels - 1)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])

    def unpack(p):
        return p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

    def loss(p):
        w, t = unpack(p)
        z = x @ w
        low = np.concatenate([np.full((n, 1), 0.0), _sigmoid(t[None] - z[:, None]), np.full((n, 1), 1.0)], 1)
        prob = np.maximum(np.take_along_axis(low, grade[:, None] + 1, 1) - np.take_along_axis(low, grade[:, None], 1), 1e-12)[:, 0]
        slope = low * (1 - low)
        up, down = np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0], np.take_along_axis(slope, grade[:, None], 1)[:, 0]
        dz = (up - down) / prob / n
        gt = np.array([np.sum(np.where(grade == k, up, 0) / prob - np.where(grade == k + 1, down, 0) / prob) for k in range(levels - 1)]) / -n
        gaps = np.exp(p[d + 1 :])
        g = np.concatenate([x.T @ dz + penalty * w / n * d, gt[:1] + gt[1:].sum(), [gt[j + 1 :].sum() * gaps[j] for j in range(levels - 2)]])
        return -np.log(prob).mean() + penalty * (w @ w) / 2 / n * d, g

    p, rate = free, 1.0
    value, g = loss(p)
    moment = np.zeros_like(p)
    for _ in range(steps):
        moment = 0.9 * moment + g
        q = p - rate * moment
        v, gq = loss(q)
        if v > value + 1e-12:
            rate, moment = rate / 2, np.zeros_like(p)
            if rate < 1e-6:
                break
            continue
        p, value, g, rate = q, v, gq, min(rate * 1.05, 50.0)
    w, t = unpack(p)
    return w, t


def _dense_features(column: pa.Array) -> list[np.ndarray]:
    """Per text the names of which it holds one or more among `DENSE` words."""
    out = []
    for part in _pieces(column):
        bounds, found = _occurrences(part)
        cut = [(np.searchsorted(at, bounds), x) for at, x in found]
        for i in range(len(part)):
            names, times = np.unique(np.concatenate([x[b[i] : b[i + 1]] for b, x in cut]), return_counts=True)
            out.append(names[times * DENSE >= bounds[i + 1] - bounds[i]])
    return out


def _from_chance(n, k, texts, bad):
    """Signed root of the likelihood ratio: a feature of n texts, k of them bad, against those without it."""

    def part(k, n):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(n, 1e-300)), 0.0)

    def both(k, n):
        return part(k, n) + part(n - k, n)

    ratio = both(k, n) + both(bad - k, texts - n) - both(bad, texts)
    return np.where(k * texts > n * bad, np.sqrt(np.maximum(2 * ratio, 0)), 0.0)


def _chosen(dense: np.ndarray, names: np.ndarray, far: np.ndarray) -> list[int]:
    """Columns of `dense` (text x feature), farthest from chance first, without those whose texts one of another length, chosen before, holds already."""
    out: list[int] = []
    n, kind = dense.sum(0, dtype=np.int64), (names & np.uint64(15)).astype(int)
    # of equals the longest goes first, then by name
    for c in np.lexsort((names, -kind, -far)):
        others = [o for o in out if kind[o] != kind[c]]  # of one length neither is the other's beginning
        if not n[c] or len(others) and (dense[:, others] & dense[:, c : c + 1]).sum(0).max() >= COVERED * n[c]:
            continue
        out.append(int(c))
    return out


def _signatures(column: pa.Array) -> list[list[int]]:
    """Per text the least hashes of its three-word runs, by a few hash functions: near copies share one."""
    buf, off = text_buffer(column)
    _, h, b = words(lowered(buf), off, ALNUM_WORDS)
    runs = mix64(mix64(h[:-2] + mix64(h[1:-1])) ^ h[2:]) if len(h) > 2 else h[:0]
    out = []
    for i, j in zip(b[:-1].tolist(), b[1:].tolist()):
        own = runs[i : max(i, j - 2)]
        out.append([int((mix64(own ^ np.uint64(k)).min() ^ np.uint64(k)).view(np.int64)) for k in range(1, 1 + COPY_HASHES)] if len(own) else [])
    return out


def fit(docs: DataFrame, labels: DataFrame, grade: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, lang_col: str = "lang", bad_from: int = 1) -> CumulativeLink:
    """A model from labelled rows; `grade` is an SQL expression over the labels' columns: the larger, the worse, from 0 on. Without `lang_col` all texts are of one language."""
    none = CumulativeLink(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]))
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.expr(grade).cast("int").alias("grade"))
    grades = given.where("grade >= 0").groupBy("id").agg(F.max("grade").alias("grade"))
    n = grades.count()
    if n > max_rows:
        grades = grades.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    # the sample's ids are bounded by max_rows
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def signed(batches):
        let_go()
        for batch in sliced(batches, "text"):
            sigs = [x for part in _pieces(batch["text"]) for x in _signatures(part)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["grade"], batch["lang"], batch["text"], pa.array(sigs, pa.list_(pa.int64()))], ["row", "id", "grade", "lang", "text", "sigs"])

    sample = rows.join(F.broadcast(grades), "id").select(F.monotonically_increasing_id().alias("row"), "id", "grade", "lang", "text")
    sample = sample.mapInArrow(signed, T.StructType([*sample.schema, T.StructField("sigs", T.ArrayType(T.LongType()))])).persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(sample, none, bad_from)
    finally:
        sample.unpersist()


def _fitted(sample: DataFrame, none: CumulativeLink, bad_from: int) -> CumulativeLink:
    spark = sample.sparkSession
    known = sample.select("row", "id", "grade", "lang", "sigs").orderBy("id", "row").toArrow()
    known = known.take(pa.array(_distinct(known["id"].to_pylist(), known["sigs"].to_pylist()), pa.int64()))
    grade, row = known["grade"].to_numpy().astype(int), known["row"].to_numpy()
    toxic = grade >= bad_from
    if not len(known) or toxic.all() or not toxic.any():
        return none
    langs, group = np.unique(known["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    fold = _dealt(group * 2 + toxic)
    # (language, fold and badness): texts
    slot = fold * 2 + toxic
    texts = np.zeros((len(langs), 2 * FOLDS), np.int64)
    np.add.at(texts, (group, slot), 1)
    order = np.argsort(row)
    shared = spark.sparkContext.broadcast((row[order], group[order], slot[order]))

    def picked(batch):
        rows, group, slot = shared.value
        own = batch["row"].to_numpy()
        at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
        keep = rows[at] == own
        return batch.filter(pa.array(keep)), group[at[keep]], slot[at[keep]]

    # in how many texts each word stands: counted over the sample by the tasks, so that the driver holds candidates only
    def exploded(batches):
        let_go()
        for batch in batches:
            own, g, s = picked(batch)
            lists = _dense_features(own["text"])
            size = [len(x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g, size).astype(np.int32)), pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)), pa.array(np.repeat(s, size).astype(np.int32))], ["lang", "word", "slot"])

    def far(batches):
        let_go()
        for batch in batches:
            g, held = batch["lang"].to_numpy(), np.stack([batch[f"n{j}"].to_numpy() for j in range(2 * FOLDS)], 1)
            for split in range(FOLDS + 1):
                use = np.arange(2 * FOLDS) // 2 != split  # the last one leaves nothing out
                bad = use & (np.arange(2 * FOLDS) % 2 == 1)
                n = held[:, use].sum(1)
                z = _from_chance(n, held[:, bad].sum(1), texts[g][:, use].sum(1), texts[g][:, bad].sum(1))
                good = np.flatnonzero((n >= MIN_TEXTS) & (z >= MIN_Z[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), split, np.int32)), batch["lang"].take(pa.array(good)), batch["word"].take(pa.array(good)), pa.array(z[good])], ["split", "lang", "word", "z"])

    words_of = sample.select("row", "text").mapInArrow(exploded, "lang int, word long, slot int").groupBy("lang", "word")
    counted = words_of.agg(*(F.sum((F.col("slot") == j).cast("long")).alias(f"n{j}") for j in range(2 * FOLDS)), F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
    best = W.partitionBy("split", "lang").orderBy(F.desc("z"), "word")
    wanted = counted.drop("n").mapInArrow(far, "split int, lang int, word long, z double").withColumn("place", F.row_number().over(best)).where(F.col("place") <= CANDIDATES).drop("place").toArrow()
    split, lang_of, z = (wanted[c].to_numpy() for c in ("split", "lang", "z"))
    names, column = np.unique(wanted["word"].to_numpy().view(np.uint64), return_inverse=True)

    # how often each text holds each candidate: at most max_rows x the candidates of all languages
    def held(batches):
        let_go()
        for batch in batches:
            own, _, _ = picked(batch)
            for rows, part in zip(_row_pieces(own), _pieces(own["text"])):
                counts, size = _counts(part, names)
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([rows, pa.array(size.astype(np.int64)), pa.array(at, pa.list_(pa.int32())), pa.array([c[a] for c, a in zip(counts, at)], pa.list_(pa.int32()))], ["row", "n", "at", "times"])

    got = sample.select("row", "text").mapInArrow(held, "row long, n long, at array<int>, times array<int>").toArrow()
    place = dict(zip(row.tolist(), range(len(row))))
    counts, n_words = np.zeros((len(row), len(names)), np.int32), np.zeros(len(row), np.int64)
    for r, size, at, times in zip(*(got[c].to_pylist() for c in ("row", "n", "at", "times"))):
        counts[place[r], at], n_words[place[r]] = times, size

    def model_of(which: int, bar: float) -> CumulativeLink:
        train = fold != which
        chance: dict[int, float] = {}
        for g in range(len(langs)):
            own = np.flatnonzero((split == which) & (lang_of == g) & (z >= bar))
            texts_of = np.flatnonzero(train & (group == g))
            cols = column[own]
            part = counts[np.ix_(texts_of, cols)]
            clean = ~toxic[texts_of]
            for c in _chosen(part * DENSE >= np.maximum(n_words[texts_of], 1)[:, None], names[cols], z[own]):
                chance[cols[c]] = max(chance.get(cols[c], 0.0), part[clean, c].sum() / max(1, n_words[texts_of][clean].sum()))
        cols = np.array(sorted(chance), int)
        rate = np.array([chance[c] for c in cols.tolist()])
        x = _values(counts[np.ix_(train, cols)], n_words[train], rate)
        y = grade[train]
        if not len(cols) or y.max() == y.min():
            return none
        weights, thresholds = fit_ordinal(x, y, int(y.max()) + 1, penalty=PENALTY / len(cols))
        return CumulativeLink(names[cols], weights, thresholds, rate)

    def left_out(bar: float) -> tuple[float, np.ndarray]:
        """Log loss of being bad, and severities, each row's by a model that hasn't seen it."""
        out, bad = np.zeros(len(row)), np.zeros(len(row))
        for k in range(FOLDS):
            model, test = model_of(k, bar), fold == k
            x = _values(counts[np.ix_(test, np.searchsorted(names, model.features))], n_words[test], model.chance)
            out[test], bad[test] = model.severity(x), _sigmoid(x @ model.weights - model.thresholds[min(bad_from, len(model.thresholds)) - 1])
        bad = np.clip(bad, 1e-4, 1 - 1e-4)
        return -np.log(np.where(toxic, bad, 1 - bad)).mean(), out

    tried = [(*left_out(bar), bar) for bar in MIN_Z]
    _, out, bar = min(tried, key=lambda x: x[0])
    model = model_of(FOLDS, bar)
    cut = _cut(out, toxic)
    said = out >= cut
    model.reject = cut
    model.held_out = tuple((str(name), int(o.sum()), int((o & toxic).sum()), int((o & said & toxic).sum()), int((o & said & (~toxic)).sum())) for g, name in enumerate(langs) for o in [group == g])
    return model


def _row_pieces(batch: pa.RecordBatch):
    at = 0
    for part in _pieces(batch["text"]):
        yield batch["row"].slice(at, len(part))
        at += len(part)


def _distinct(ids: list, sigs: list[list[int]]) -> list[int]:
    """Places of the first row of each id, of which no earlier one is a near copy: chance words of copies would look like signs."""
    seen, signs, out = set(), set(), []
    for i, (own, s) in enumerate(zip(ids, sigs)):
        if own not in seen:
            seen.add(own)
            if signs.isdisjoint(s):
                out.append(i)
            signs.update(s)
    return out


def _dealt(kind: np.ndarray) -> np.ndarray:
    """A fold for each row, so that each has its share of every kind."""
    out = np.zeros(len(kind), int)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        out[at] = (np.arange(len(at)) + k) % FOLDS
    return out


def _cut(severity: np.ndarray, bad: np.ndarray) -> float:
    """The lowest cut at which `PRECISION` of the rejected are bad, halfway (of the logs) to the next severity below; beyond all, if there is none."""
    at, place = np.unique(severity, return_inverse=True)
    beyond = np.cumsum(np.bincount(place, minlength=len(at))[::-1])[::-1]
    caught = np.cumsum(np.bincount(place, bad, len(at))[::-1])[::-1]
    good = np.flatnonzero(caught >= PRECISION * beyond)
    if not len(good):
        return float("inf")
    i = int(good[0])
    return float(np.sqrt(at[i] * at[i - 1]) if i else at[i])


def severity(docs: DataFrame, model: CumulativeLink, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `severity`, the expected grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [f for n in keep for f in docs.schema.fields if f.name == n]

    def run(batches):
        let_go()
        for batch in sliced(batches, "__text"):
            got = shared.value.severity(shared.value.rows(batch["__text"]))
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in carried), pa.array(got)], [*(f.name for f in carried), "severity"])

    source = docs.select(*(F.col(f"`{f.name}`") for f in carried), F.col(f"`{text_col}`").alias("__text"))
    return source.mapInArrow(run, T.StructType([*carried, T.StructField("severity", T.DoubleType())]))
