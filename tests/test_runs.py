import hashlib
import json

import pytest

from skeinrank.sources import readers, runs

RUN, OTHER = "20260726T000001Z", "20260726T000002Z"


def metric(**changes):
    return {f.split()[0]: (0.5 if f.endswith("double") else 2) for f in runs.METRIC.split(", ")} | changes


def catalog(*ids, latest=RUN, **changes):
    entry = lambda i: {"run_id": i, "title": "t", "sample": {"kind": runs.SAMPLE_KIND, "question_count": 5, "source_split_question_count": 9, "sampling_seed": "s"}, "recommendation": {"strategy": "dense", "rationale": "r", "scope": "s"}}
    return {"schema_version": 1, "latest_run_id": latest, "runs": [entry(i) for i in ids]} | changes


def results(run=RUN, **changes):
    return {"run_id": run, "mode": "m", "config_path": "c", "embedding": {"provider": "p", "model": "e", "size": 3}, "generation_model": "g", "judge_provider": "p", "judge_model": "j", "k": 5, "n_chunks": 9, "metrics": {"dense": metric()}} | changes


def manifest(run=RUN, **changes):
    return {"run_id": run, "status": "completed", "git_sha": "abc", "completed_at": "2026-07-26T00:00:00+00:00"} | changes


def put(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def shown(spark, root, cat, res, man):
    put(root / "experiments" / "published-runs.json", cat)
    for name, docs in (("experiments/{}/results.json", res), ("artifacts/runs/{}/manifest.json", man)):
        for run, doc in docs.items():
            put(root / name.format(run), doc)
    read = runs.published(runs.read_catalog(spark, f"{root}/experiments/published-runs.json"), runs.read_results(spark, f"{root}/experiments/*/results.json"), runs.read_manifests(spark, f"{root}/artifacts/runs/*/manifest.json"))
    return {r.run_id: r for r in read.collect()}, read


def test_published_run(spark, tmp_path):
    got, read = shown(spark, tmp_path, catalog(RUN, OTHER), {RUN: results(), OTHER: results(OTHER), "unlisted": results("unlisted")}, {RUN: manifest(), OTHER: manifest(OTHER)})
    assert {i: (r.fault, r.latest) for i, r in got.items()} == {RUN: (None, True), OTHER: (None, False)}
    assert (got[RUN].embedding_model, got[RUN].judge_model, got[RUN].chunk_count, got[RUN].recommendation.strategy) == ("p/e", "p/j", 9, "dense")
    assert [(r.strategy, r.mrr, r.errors) for r in runs.run_metrics(read).where(f"run_id = '{RUN}'").collect()] == [("dense", 0.5, 4)]


@pytest.mark.parametrize(
    "res, man, fault",
    [
        (results("x"), manifest(), "results: of another run"), ("[1]", manifest(), "results: no JSON object"), ("{", manifest(), "results: no JSON object"), (results(k=0), manifest(), "results: k and n_chunks must be positive"),
        (results(metrics={}), manifest(), "results: no metrics"), (results(metrics={"dense": metric(mrr=None)}), manifest(), "results: a metric isn't a finite number"), (results(metrics={"dense": metric(mrr=float("nan"))}), manifest(), "results: no JSON object"),
        (results(metrics={"raptor": metric()}), manifest(), "recommended strategy has no metrics"), (results(mode=None), manifest(), "results: mode is missing or of another type"), (results(pad="x" * runs.LARGEST), manifest(), f"results: larger than {runs.LARGEST} bytes"),
        (results(), manifest("x"), "manifest: of another run"), (results(), manifest(status="running"), "manifest: not completed"), (results(), manifest(completed_at="2026-07-26T00:00:00"), "manifest: no time with a zone"), (results(), manifest(completed_at="soonZ"), "manifest: no time with a zone"),
    ],
)
def test_faults_of_a_run(spark, tmp_path, res, man, fault):
    assert shown(spark, tmp_path, catalog(RUN), {RUN: res}, {RUN: man})[0][RUN].fault == fault


def test_files_that_are_absent(spark, tmp_path):
    got, _ = shown(spark, tmp_path, catalog(RUN, OTHER), {RUN: results()}, {OTHER: manifest(OTHER)})
    assert {i: r.fault for i, r in got.items()} == {RUN: "manifest: no file", OTHER: "results: no file"}


@pytest.mark.parametrize(
    "cat, fault",
    [
        (catalog(RUN, schema_version=2), "another version"), (catalog(RUN, latest=OTHER), "the latest run isn't listed"), (catalog(RUN, RUN), "a run is listed twice"), (catalog(RUN, "../" + RUN), "malformed run id"), (catalog(RUN, more=1), "unknown fields"),
        (catalog(RUN) | {"runs": [catalog(RUN)["runs"][0] | {"extra": 1}]}, "unknown fields"), (catalog(RUN) | {"runs": [{"run_id": RUN}]}, "title is missing or of another type"),
    ],
)
def test_faults_of_a_catalog(spark, tmp_path, cat, fault):
    assert {r.fault for r in runs.read_catalog(spark, put(tmp_path / "c.json", cat)).collect()} == {fault}


def test_pieces_and_plain_digests(spark, tmp_path):
    root = tmp_path / "a b%20"
    (root / "sub").mkdir(parents=True)
    data = {"big.bin": bytes(range(256)) * 41, "sub/é.txt": b"x" * 1000, "empty": b""}
    for name, content in data.items():
        (root / name).write_bytes(content)
    found = runs.file_pieces(spark, str(root), 1000)
    expected = {(n, i): hashlib.sha256(c[i * 1000 : i * 1000 + 1000]).hexdigest() for n, c in data.items() for i in range(max(1, -(-len(c) // 1000)))}
    before = {(r.relative_path, r.piece): r.digest for r in found.collect()}
    assert before == expected
    assert {r.relative_path: r.digest for r in runs.file_digests(spark, str(root)).collect()} == {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}
    kept = readers.stored(found, "pieces")
    (root / "big.bin").write_bytes(data["big.bin"][:3500] + b"!" + data["big.bin"][3501:9500])
    (root / "empty").unlink()
    (root / "new").write_bytes(b"n")
    faults = {(r.relative_path, r.piece): r.reason for r in runs.piece_faults(kept, runs.file_pieces(spark, str(root), 1000)).collect()}
    assert faults == {("big.bin", 3): "modified", ("big.bin", 9): "modified", ("big.bin", 10): "missing", ("empty", 0): "missing", ("new", 0): "extra"}


def test_last_record_by_line_over_many_ranges(spark, tmp_path):
    lines = [json.dumps({"question_id": f"q{i % 7}", "strategy": "s", "answer_text": str(i), "metrics": {"m": float(i)}}) for i in range(4000)]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.question_id: r.metrics["m"] for r in readers.read_records(spark, str(tmp_path / "r.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"q{i % 7}": float(i) for i in range(3993, 4000)}
    (tmp_path / "bad.jsonl").write_text(json.dumps({"question_id": "q", "strategy": "s", "metrics": {"m": float("nan")}}))
    with pytest.raises(Exception, match="a metric isn't a finite number: q"):
        readers.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
