"""Run records: merging, appending, deduplication, usage, integrity, evidence and calibration."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from .scan import previous, running_before


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: the largest of `order`, aggregated before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}") for c in rest))


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def merge_answers(retrieval: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """retrieval(..., retrieval_status, error), answers(..., answer_status, answer_error): answers that are missing are not applicable."""
    both = retrieval.join(answers, keys, "left")
    errors = F.filter(F.array("error", "answer_error"), lambda e: e.isNotNull() & (e != ""))
    return both.select(*keys, "retrieval_status", F.coalesce("answer_status", F.lit("not_applicable")).alias("answer_status"), errors.alias("errors"))


def usage(calls: DataFrame, group: list[str], input_price: float | None, output_price: float | None) -> DataFrame:
    """Calls, latency, tokens and cache hits; the cost only when both prices are given."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    cost: Column = F.lit(None).cast("double")
    if input_price is not None and output_price is not None:
        cost = F.round((total("prompt_tokens") * input_price + total("completion_tokens") * output_price) / 1e6, 9)
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), F.round(F.sum("latency"), 6).alias("latency"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), F.count_if("cache_hit").alias("cache_hits"), cost.alias("cost"))


def unknown_refs(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs(ref_id, norm) that known(ref_id, norm) lacks, with the reason."""
    norms = known.select("norm").distinct()
    a = refs.join(norms, "norm", "left_anti").withColumn("reason", F.lit("unknown norm"))
    b = refs.join(norms, "norm", "left_semi").join(known.select("ref_id"), "ref_id", "left_anti").withColumn("reason", F.lit("unknown id"))
    return a.select("ref_id", "norm", "reason").unionByName(b.select("ref_id", "norm", "reason"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, and keys that either repeats."""
    a = left.groupBy(key).agg(F.count("*").alias("l"))
    b = right.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full")
    reason = F.when(F.col("l").isNull(), "missing left").when(F.col("r").isNull(), "missing right").when((F.col("l") > 1) | (F.col("r") > 1), "duplicate")
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(key, "reason")


#: The envelope of an event: kind of each field in its canonical form, beside its own hash.
ENVELOPE = {
    "schema_version": "number", "sequence": "number", "event_id": "string", "run_id": "string", "correlation_id": "string",
    "stage": "string", "event_type": "string", "occurred_at": "string", "payload_hash": "string", "previous_event_hash": "string",
}


def event_hash() -> Column:
    """An event's digest, of all its envelope but the digest itself."""
    return F.sha2(canonical_json(**{k: (kind, F.col(k)) for k, kind in ENVELOPE.items()}), 256)


def chained(events: DataFrame) -> DataFrame:
    """Events of a run numbered and chained in the order of `ord`: run_id, ord, event_id, correlation_id, stage, event_type,
    occurred_at, payload_hash come in. A chain is sequential by nature, so a run is one group's work; runs are independent."""
    rows = events.withColumn("schema_version", F.lit(1)).withColumn("correlation_id", F.coalesce("correlation_id", "run_id"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord").reset_index(drop=True)
        frame["sequence"] = np.arange(1, len(frame) + 1)
        before, hashes, links = None, [], []
        for row in frame.to_dict("records"):
            body = {k: row.get(k) for k in ENVELOPE} | {"previous_event_hash": before, "schema_version": 1, "sequence": int(row["sequence"])}
            links.append(before)
            before = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
            hashes.append(before)
        return frame.assign(previous_event_hash=links, event_hash=hashes)[[*ENVELOPE, "event_hash"]]

    schema = ", ".join(f"{k} {'int' if k == 'schema_version' else 'long' if kind == 'number' else 'string'}" for k, kind in ENVELOPE.items())
    return rows.groupBy("run_id").applyInPandas(run, f"{schema}, event_hash string")


def chain_faults(events: DataFrame) -> DataFrame:
    """(run_id, sequence, fault), a row for each thing wrong with an event: its own hash isn't that of its content, its
    number doesn't follow, its link isn't the hash of the event before (null for the first). A run may have any length."""
    step = previous(events, ["run_id"], ["sequence", "event_hash"], {"before": "event_hash", "last": "sequence"})
    faults = F.array(
        F.when(F.col("event_hash") != event_hash(), "content changed"),
        F.when(F.col("last").isNotNull() & (F.col("sequence") != F.col("last") + 1), "sequence gap"),
        F.when(~F.col("previous_event_hash").eqNullSafe(F.col("before")), "broken link"),
    )
    return step.select("run_id", "sequence", F.explode(F.array_compact(faults)).alias("fault"))


# ---------------------------------------------------------------- agreement of two raters


def kappa(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Quadratic weighted kappa of (a, b); weights scale by the categories that are present, so one category alone agrees fully."""
    cells = pairs.groupBy(*group, "a", "b").agg(F.count("*").alias("n"))
    present = cells.select(*group, F.explode(F.array_distinct(F.array("a", "b"))).alias("c")).distinct()
    order = W.partitionBy(*group).orderBy("c")
    index = present.withColumn("i", F.row_number().over(order) - 1)
    count = index.groupBy(*group).agg(F.count("*").alias("k"))
    total = cells.groupBy(*group).agg(F.sum("n").alias("total"))
    a = index.withColumnsRenamed({"c": "a", "i": "ia"})
    b = index.withColumnsRenamed({"c": "b", "i": "ib"})
    rows = cells.groupBy(*group, "a").agg(F.sum("n").alias("na")).join(a, [*group, "a"])
    cols = cells.groupBy(*group, "b").agg(F.sum("n").alias("nb")).join(b, [*group, "b"])
    weight = F.coalesce(F.try_divide(F.pow(F.col("ia") - F.col("ib"), 2), F.pow(F.col("k") - 1, 2)), F.lit(0.0))
    seen = cells.join(a, [*group, "a"]).join(b, [*group, "b"]).join(count, group).groupBy(*group).agg(F.sum(weight * F.col("n")).alias("observed"))
    # a few categories a side
    chance = rows.join(cols, group).join(count, group).groupBy(*group).agg(F.sum(weight * F.col("na") * F.col("nb")).alias("expected"))
    out = total.join(seen, group).join(chance, group)
    return out.select(*group, F.round(F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.try_divide(F.col("observed") * F.col("total"), F.col("expected"))), 6).alias("kappa"), F.col("total").alias("n"))


def spearman(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Pearson's correlation of average ranks, null when a side is constant. Ranks come from the values' counts, which
    are added up range by range, so a group may hold all rows and as many values."""

    def ranks(side: str) -> DataFrame:
        n = pairs.groupBy(*group, side).agg(F.count("*").alias("n"))
        return running_before(n, group, [side], "n", "below").select(*group, side, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{side}"))

    both = pairs.join(ranks("a"), [*group, "a"]).join(ranks("b"), [*group, "b"])
    s = both.groupBy(*group).agg(F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("x"), F.stddev_pop("rb").alias("y"), F.count("*").alias("n"))
    return s.select(*group, F.round(F.when((F.col("x") > 0) & (F.col("y") > 0), F.try_divide(F.col("c"), F.col("x") * F.col("y"))), 6).alias("spearman"), "n")


def support_rates(pairs: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Of judged scores a and human scores b: the share of what the judge supports that the human denies, of what it denies
    that the human supports, and how often both say the same."""
    up, yes = F.col("a") >= threshold, F.col("b") >= threshold
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.count_if(x), F.count_if(y)), F.lit(0.0)), 6)
    return pairs.groupBy(*group).agg(share(up & ~yes, up).alias("false_supported"), share(~up & yes, ~up).alias("false_unsupported"), share(up == yes, F.lit(True)).alias("agreement"))
