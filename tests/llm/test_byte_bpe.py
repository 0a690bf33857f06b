import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from skeinrank.llm.byte_bpe import bpe_encode, codec, read_ranks

from .helpers import SF, crowded, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(codec(read_ranks(PATH), P.PATTERN).encode(text), "<u4").tolist()


def test_every_code_point(library):
    for i in range(0, 0x110000, 7):
        if not 0xD800 <= i < 0xE000:
            assert ids(f"a {chr(i)}b 1") == library.encode_ordinary(f"a {chr(i)}b 1")


def test_random_strings(library):
    rng = random.Random(5)
    alphabet = ["a", "e", "n", "th", "in", "é", "ß", " ", "\n", "  ", "1", "'s", "!", "日", "\t", "T"]
    for _ in range(5000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        assert ids(s) == library.encode_ordinary(s)
    for ch in "an \n!1é":
        for n in [*range(1, 40), 3001]:
            assert ids(ch * n) == library.encode_ordinary(ch * n)


def test_long_text_in_parts(library, monkeypatch):
    monkeypatch.setattr("skeinrank.llm.byte_bpe.PART", 50)
    text = "It's a long   text, with 12345 numbers\n\n and words' ends. " * 40
    assert ids(text) == library.encode_ordinary(text)


def test_frame(spark, library):
    rows = bpe_encode(crowded(frame(spark), "ids", "n_tokens"), PATH, P.PATTERN).collect()
    assert len(rows) == 13
    texts = {r.doc_id: r.text for r in frame(spark).collect()}
    for r in rows:
        own = texts[r.doc_id] or ""
        assert bytes(r.decoded) == own.encode()
        assert r.n_tokens == len(r.ids) // 4 == len(library.encode_ordinary(own))
    assert bpe_encode(frame(spark, []), PATH, P.PATTERN).count() == 0


def test_query(spark, library):
    import hashlib

    import numpy as np

    from skeinrank.llm.queries import op8_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op8_byte_bpe(spark, SF).collect():
        own = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_long_pieces_are_not_kept():
    from skeinrank.llm.byte_bpe import PIECE_SIZE

    own = codec(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    for i in range(50):
        text = f"{chr(97 + i % 26)}" * 3000 + str(i)
        assert own.decode(own.encode(text)) == text.encode()
    assert max(map(len, own.pieces)) <= PIECE_SIZE
