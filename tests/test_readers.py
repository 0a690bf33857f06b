import json

from skeinrank.sources import readers, runs


def test_judgments_split_and_records(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"version": "1", "judgments": [{"question_id": "q", "text": "t", "relevant_refs": [{"ref": "N::a", "grade": "relevant"}, {"ref": "N::a", "grade": "partially_relevant"}]}]}))
    j = readers.read_judgments(spark, str(tmp_path / "j.json"))
    assert [tuple(r) for r in readers.qrels(j).collect()] == [("q", "N::a", "N", 0.5)]
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a"], "validation": [], "test": ["b", "c"]}))
    assert sorted(tuple(r) for r in readers.read_split(spark, str(tmp_path / "s.json")).collect()) == [("a", "train", 0), ("b", "test", 0), ("c", "test", 1)]
    rows = [{"question_id": "q", "strategy": "s", "metrics": {"m": x}} for x in (1.0, 2.0)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.metrics for r in readers.read_records(spark, str(tmp_path / "r.jsonl")).collect()] == [{"m": 2.0}]


def test_checksums(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("a")
    (root / "sub" / "b.txt").write_text("b")
    found = {r.relative_path: r.digest for r in runs.file_digests(spark, str(root)).collect()}
    (tmp_path / "sums").write_text(f"{found['a.txt']}  a.txt\n{'0' * 64}  sub/b.txt\n{'1' * 64}  gone.txt\n")
    faults = readers.checksum_faults(readers.read_checksums(spark, str(tmp_path / "sums")), runs.file_digests(spark, str(root))).collect()
    assert {r.relative_path: r.reason for r in faults} == {"sub/b.txt": "modified", "gone.txt": "missing"}
