import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tracewright.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    some = "aab  \n\t'sSdé漢🙂=+0129 \r.\x00 'rvelltm"
    made = ["".join(rng.choice(some) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [None, "", "'", "it's we'll", "x" * 3000, "<|endoftext|>", "the quick brown fox " * 2000, *made, *made[:5]]


def test_ids_and_round_trip(spark, docs_of):
    rows = texts()
    docs = docs_of(rows).withColumn("ids", F.lit("clash"))
    got = {r[0]: tuple(r[1:]) for r in bpe.encode_digests(docs, PATH, PATTERN).collect()}
    for i, text in enumerate(rows):
        ids = ENCODING.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()), text
    back = {r[0]: r[1] for r in bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(rows)}
    assert bpe.encode_digests(docs_of([]), PATH, PATTERN).count() == 0


def test_other_pattern():
    pattern = r"\p{L}+|\s+|[^\p{L}\s]+"
    own = bpe.Bpe(bpe.read_ranks(PATH), pattern)
    other = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    raw = "It's  a wordè 12 times".encode()
    ids, count = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == other.encode_ordinary(raw.decode()) and count.tolist() == [len(ids)]


def test_long_pieces_of_equal_polynomial_hash():
    """Pieces that agree under any polynomial modulo 2**64, and random long ones, have ids of their own."""
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    rng = random.Random(9)
    made = ["".join(rng.choice("abcdé") for _ in range(rng.choice([255, 256, 257, 1500]))) for _ in range(20)]
    rows = [one[:1024], two[:1024], one, two, *made]
    raw = [r.encode() for r in rows]
    ids, count = bpe.Bpe(bpe.read_ranks(PATH), PATTERN).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [ENCODING.encode_ordinary(r) for r in rows]
