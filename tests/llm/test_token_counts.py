import numpy as np
import public_tokenizers as P

from skeinrank.llm import token_counts as tc
from skeinrank.llm.byte_bpe import codec, read_ranks
from skeinrank.llm.queries import op4_token_counts
from skeinrank.llm.token_counts import read_token_files, token_counts, write_token_files, write_tokens

from .helpers import SF, crowded, frame

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(ids, eod):
    out, n = [], 0
    for x in ids:
        if x == eod:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


def test_blocks_cut_anywhere(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for file in range(25):
        ids = rng.integers(0, rng.choice([2, 4, 40]), rng.integers(0, 120)).astype("<u2")
        want[file] = brute(ids.tolist(), 0)
        lo, k = 0, 0
        while lo < len(ids):
            n = int(rng.integers(0, 12))
            rows.append((file, k, ids[lo : lo + n].tobytes()))
            lo, k = lo + n, k + 1
    got = {}
    for r in token_counts(spark.createDataFrame(rows, "file long, block long, data binary").repartition(5), 0).orderBy("file", "doc").collect():
        got.setdefault(r.file, []).append((r.n_tokens, r.closed))
        assert r.doc == len(got[r.file]) - 1
    assert got == {k: v for k, v in want.items() if v}


def test_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK_IDS", 7)
    ids = np.random.default_rng(1).integers(0, 9, 200).astype("<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = read_token_files(spark, str(tmp_path), 4)
    assert blocks.count() == 29
    got = token_counts(blocks, 5, 4).orderBy("doc").collect()
    assert [(r.n_tokens, r.closed) for r in got] == brute(ids.tolist(), 5)
    # a store that Python can't open comes whole
    monkeypatch.setattr(tc, "local_path", lambda p: None)
    assert sorted(map(tuple, token_counts(read_token_files(spark, str(tmp_path), 4), 5, 4).collect())) == sorted(map(tuple, got))


def test_written_files(spark, tmp_path):
    df = crowded(frame(spark), "file", "first", "ids")
    listed = write_token_files(df, str(tmp_path / "files"), PATH, P.PATTERN, 50256).cache()
    own = codec(read_ranks(PATH), P.PATTERN)
    assert sorted(i for r in listed.collect() for i in r.ids) == sorted(r.doc_id for r in df.collect())
    got = token_counts(read_token_files(spark, str(tmp_path / "files")), 50256).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(own.encode(r.text)) // 4 for r in df.collect())


def test_odd_rows_and_empty(spark, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK_IDS", 1000)
    df = crowded(frame(spark), "file", "block", "data", "ids")
    files = write_tokens(df, PATH, P.PATTERN, 50256).cache()
    own = codec(read_ranks(PATH), P.PATTERN)
    assert sorted(r.n_tokens for r in token_counts(files, 50256).collect()) == sorted(len(own.encode(r.text)) // 4 for r in df.collect())
    assert token_counts(write_tokens(frame(spark, []), PATH, P.PATTERN, 50256), 50256).count() == 0


def test_query(spark):
    own = codec(read_ranks(PATH), P.PATTERN)
    want = sorted((r.doc_id, len(own.encode(r.text)) // 4) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in op4_token_counts(spark, SF).collect()) == want
