import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from codeloom.llm import bpe


@pytest.fixture(scope="module")
def oracle():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.public_vocabulary())


TEXTS = ["", " ", "  ", "Hello world", " It's 12345 \t\n\n  x", "a b c 　", "日本語 テキスト", "👩‍👩‍👧 é́", "x" * 5000, "\x1c\x1d a\x1f b \x85 c", "<|endoftext|> ▁ <unk>", "don't DON'T we'll", "\r\n \r\n", "  lead", "trail  ", "a  b   c", "﻿BOM\x00nul", "١٢٣ ½ ²"]


def test_same_ids_as_the_library(codec, oracle):
    rng = random.Random(1)
    pieces = [*TEXTS, *"abcde", " ", "  ", "\n", "'s", ".", "é", "ß", "‍", " ", "9", "\t"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0x10000, 0x20000)])) for _ in range(30)) for _ in range(500)]
    for text, (ids, shown) in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids == oracle.encode_ordinary(text), repr(text)
        assert shown == ",".join(map(str, ids))
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", None])
def test_white_space_that_is_known_already(name):
    """What one batch has learnt must not change how another is cut."""
    ranks = {bytes([b]): b for b in range(256)} | {b"  ": 256, b"  \n": 257, b" \n": 258, b"\n ": 259, b"   ": 260}
    if name:
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = bpe.read_ranks(f)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["a  b", "a   b", "x \n", "a \n  b", " \n", "\n\n", "a\n\n b", "  ", "a    b", "c\t d", "\t", "e \t f"]
    texts += ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "é", ".", "1"]) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    for text in texts:
        assert codec.encode(text) == oracle.encode_ordinary(text), repr(text)


def test_decoding_is_the_inverse_of_the_map(codec):
    """What ids mean comes from the serialised model, and is what the rank file says."""
    import gc

    chars = bpe.byte_characters()
    assert len(set(chars)) == 256
    for piece, rank in codec.ranks.items():
        assert codec.decode([rank]) == piece
    assert codec.model.id_to_piece(1 + codec.ranks[b" the"]) == chars[0x20] + "the"
    codec.encode("something new to learn")
    assert gc.isenabled()


def test_cache_starts_afresh(codec, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    for text in ["one two three four five six seven", "eight nine ten eleven", "one two"]:
        assert codec.encode(text) == oracle.encode_ordinary(text)


def test_query(spark, make_tables, oracle):
    texts = [*TEXTS, None, "long text " * 30_000, "Hello world"]
    sf = make_tables(documents=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in bpe.op7_byte_bpe(spark, sf).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = oracle.encode_ordinary(t or "")
        assert rows[i][1:4] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.op7_byte_bpe(spark, make_tables()).collect() == []


def test_decode(spark, codec):
    frame = spark.createDataFrame([(1, codec.encode("été 12")), (2, None), (3, [])], "id long, ids array<int>")
    assert {r.id: bytes(r["bytes"]) for r in bpe.decode(frame, ["id"]).collect()} == {1: "été 12".encode(), 2: b"", 3: b""}
