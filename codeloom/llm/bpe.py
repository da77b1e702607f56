"""Byte-level BPE through a sentencepiece model that is written by hand.

The rank file is turned into a serialised ``ModelProto``: every byte string becomes a piece
over 256 printable characters, scored by its negative rank, with identity normalisation.
Texts are split by the public pre-token pattern; each pre-token is encoded on its own and
ids are decoded by the inverse character map.

Cases: a null or empty text has no ids; texts of any length are encoded whole; of pieces that
could merge at several places the leftmost of the least rank does; rows are independent, so
repeated rows give equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Callable, Iterable
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces that a worker remembers, half of them from before it last made room: what is met again
#: stays, the rest goes.
CACHE_PIECES = 320_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(0x100 + n)
    return [chars[b] for b in range(256)]


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Byte string to rank, from lines of base64 and a number."""
    pairs = (line.split() for line in lines)
    return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece 0 is the unknown one, then the pieces in order of rank."""
    chars = byte_characters()
    ordered = sorted(ranks.items(), key=lambda kv: kv[1])
    out = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for piece, rank in ordered:
        text = "".join(map(chars.__getitem__, piece)).encode()
        out.append(_field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank))))
    trainer = _number(3, 2) + _number(4, len(ordered) + 1)
    for field, value in ((40, 0), (41, -1), (42, -1), (43, -1)):
        trainer += _number(field, value & (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


def odd(piece: str) -> bool:
    """Whether white space beside a piece may join it, so that cutting at spaces is not enough."""
    return not piece or piece == " " or piece[-1].isspace() or piece[piece[0] == " "].isspace()


class Codec:
    """Encode and decode with one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.rank_of_piece = [-1, *sorted(ranks.values())]
        self.shown_piece = list(map(str, self.rank_of_piece))
        chars = byte_characters()
        # Decoding goes from the model's pieces back through the characters.
        byte = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {rank: bytes(map(byte.__getitem__, self.model.id_to_piece(i))) for i, rank in enumerate(self.rank_of_piece) if i}
        self.table = {b: chars[b] for b in range(256)}
        # White space as the tokenizer library has it: Unicode's property, without U+001C-1F.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ids_of: dict[str, tuple[int, ...]] = {}
        self.text_of: dict[str, str] = {}
        self.odd: set[str] = set()
        self.older: tuple[dict[str, tuple[int, ...]], dict[str, str]] = ({}, {})

    def pretokens(self, tokens: list[str]) -> list[tuple[int, ...]]:
        """Ids of each pre-token; one that is itself in the table is a single id."""
        raw = [t.encode() for t in tokens]
        out: list[tuple[int, ...] | None] = [None] * len(raw)
        rest = []
        for i, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is None:
                rest.append(i)
            else:
                out[i] = (rank,)
        if rest:
            mapped = [raw[i].decode("latin-1").translate(self.table) for i in rest]
            for i, pieces in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                out[i] = tuple(map(self.rank_of_piece.__getitem__, pieces))
        return out  # type: ignore[return-value]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces of text, each split on its own, into the cache.

        Most are letters behind a space: one pre-token, which is its own image if it is ASCII.
        """
        words, others, ids_of, text_of, ranks = [], [], self.ids_of, self.text_of, self.ranks
        for p in pieces:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                rank = ranks.get(p.encode())
                if rank is None:
                    words.append(p)
                else:
                    ids_of[p], text_of[p] = (rank,), str(rank)
            else:
                others.append(p)
        space = self.table[0x20]
        mapped = [(space + p[1:] if p[0] == " " else p) if p.isascii() else p.encode().decode("latin-1").translate(self.table) for p in words]
        rank_of, shown = self.rank_of_piece, self.shown_piece
        for p, found in zip(words, self.model.encode(mapped, num_threads=1) if words else (), strict=True):
            ids_of[p], text_of[p] = tuple([rank_of[i] for i in found]), ",".join([shown[i] for i in found])
        self.odd.update(filter(odd, others))
        split = [self.find(p) for p in others]
        flat = iter(self.pretokens(list(chain.from_iterable(split))))
        for p, tokens in zip(others, split, strict=True):
            ids_of[p] = ids = tuple(chain.from_iterable(islice(flat, len(tokens))))
            text_of[p] = ",".join(map(str, ids))

    def unknown(self, wanted: set[str]) -> set[str]:
        """Pieces that are in neither half of the cache; those of the older half move over."""
        if len(self.ids_of) + len(wanted) > CACHE_PIECES // 2:
            self.older, self.ids_of, self.text_of = (self.ids_of, self.text_of), {}, {}
        known, shown, (ids, texts) = self.ids_of, self.text_of, self.older
        new = set()
        for p in wanted.difference(known):
            if p in ids:
                known[p], shown[p] = ids[p], texts[p]
            else:
                new.add(p)
        return new

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """``_encode_batch`` without the garbage collector, which would scan the cache's many small
        tuples again and again; they hold no cycles."""
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if was_on:
                gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids and the ids as text.

        A text is cut at single spaces, which no match of the pattern crosses while there is
        no other white space beside them; where there is, the pattern itself cuts the text.
        """
        cuts = []
        for text in texts:
            first, *rest = text.split(" ")
            cuts.append([first, *map(" ".__add__, rest)])
        wanted = set(chain.from_iterable(cuts))
        new = self.unknown(wanted)
        # White space that is known as a pre-token of its own still calls for the pattern here.
        strange = set(filter(odd, new)) | (self.odd & wanted)
        if strange:
            for i, pieces in enumerate(cuts):
                if not strange.isdisjoint(pieces):
                    cuts[i] = self.find(texts[i])
            new = self.unknown(set(chain.from_iterable(cuts)))
        self.learn(new)
        ids, shown = self.ids_of.__getitem__, self.text_of.__getitem__
        return [(list(chain.from_iterable(map(ids, c))), ",".join(map(shown, c))) for c in cuts]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0][0]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids: of each one's piece, back through the character map."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file on this machine, built once in each worker."""
    if path not in _codecs:
        with open(path, "rb") as lines:
            _codecs[path] = Codec(read_ranks(lines), pattern)
    return _codecs[path]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: Callable[[], tuple[str, str]] = public_vocabulary, with_ids: bool = True) -> DataFrame:
    """``keep`` and n_tokens, ids (array of int, if asked for), ids_sha256 and decoded_sha256."""

    def make():
        c = codec(*vocabulary())

        def run(texts: list[bytes | None]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for ids, shown in c.encode_batch([(t or b"").decode() for t in texts]):
                out["n_tokens"].append(len(ids))
                out["ids"].append(ids)
                out["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            return out

        return run

    fields = [("n_tokens", pa.int64(), "bigint"), ("ids", pa.list_(pa.int32()), "array<int>"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    fields = [f for f in fields if with_ids or f[0] != "ids"]
    return common.map_texts(docs, keep, text, make, pa.schema([(n, t) for n, t, _ in fields]), ", ".join(f"{n} {s}" for n, _, s in fields), 1 << 20)


def decode(tokens: DataFrame, keep: list[str], ids: str = "ids", vocabulary: Callable[[], tuple[str, str]] = public_vocabulary) -> DataFrame:
    """``keep`` and ``bytes``, the decoded ids (null ids: no bytes)."""
    common.ship(tokens.sparkSession)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema.fields)

    def run(batches):
        c = codec(*vocabulary())
        for batch in batches:
            made = [c.decode(x or ()) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(made, pa.binary())], names=[*keep, "bytes"])

    return tokens.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{head}, bytes binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], with_ids=False)
