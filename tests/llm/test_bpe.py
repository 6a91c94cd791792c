import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ledgerline.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.Codec(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_encodes_as_the_library_does(both):
    own, library = both
    random.seed(1)
    texts = ["", "a" * 3000, "-" * 777, " " * 500 + "x", " \n" * 300, "=+" * 400, "ab" * 1000, "é" * 500, "𝒳" * 99, "0" * 1234, "<|endoftext|>", "\x1c\x85  a"]
    for _ in range(400):
        letters = random.choice(["ab", "the ", "-=_", "0123", "éàü", "\t\n ", "thein", "☃𝒳字", "ABCabc'"])
        texts.append("".join(random.choice(letters) for _ in range(random.randint(1, 300))))
    for text in texts:
        packed = own.encode(text)
        assert ids(packed) == library.encode_ordinary(text), text[:50]
        assert own.decode(ids(packed)) == text.encode()


def test_joining_any_two_halves_is_encoding_the_whole(both):
    own, _ = both
    random.seed(2)
    for _ in range(300):
        raw = bytes(random.choice(b"aeinrst-=_0 ") for _ in range(random.randint(2, 120)))
        cut = random.randint(0, len(raw))
        assert own.join(own.tree(raw[:cut]), own.tree(raw[cut:])) == own.merged(raw)


def test_frames_keep_their_rows_and_columns(spark):
    rows = [(1, "plain text", 7), (2, None, 8), (2, "", 9), (2, "", 9), (None, "word " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode_texts(bpe.encode_texts(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((bytes(r.decoded) for r in out.collect())) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), PATH, P.PATTERN).collect() == []
