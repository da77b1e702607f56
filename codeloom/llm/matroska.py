"""Matroska columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores bytes as 8-bit PCM samples of one audio track: fixed-size laces in SimpleBlocks,
clusters and a cue for each.  ``demux`` reads any Matroska file: element ids and sizes of
variable length, unknown sizes, SimpleBlocks and BlockGroups, and all four kinds of lacing.
Media are written as a table in the shared folder, and what is said of them is read from there.

Cases: a null text is an empty one; an empty text becomes one packet of spaces; very long texts
take more clusters; broken media (``packets``) give one row with an error; null media give no
row; packets of the same time stay in the order of their places; repeated rows each give a
result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Samples in a packet, packets in a lace, laces in a cluster, samples in a second.
PACKET, LACE, CLUSTER, RATE = 192, 64, 16, 8000

# Element ids of the Matroska specification (RFC 9559), fixed values.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, VOID, CRC32 = 0x4282, 0x4287, 0x4285, 0xEC, 0xBF
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_ID, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER_ID, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end one of unknown size: its siblings and those of its parents.
_TOP = {SEGMENT, EBML, INFO, TRACKS, CLUSTER_ID, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


def vint(n: int, length: int = 0) -> bytes:
    """A size of variable length; all ones are kept for unknown sizes."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def signed_vint(n: int) -> bytes:
    length = next(k for k in range(1, 9) if abs(n) < (1 << 7 * k - 1) - 1)
    return vint(n + (1 << 7 * length - 1) - 1, length)


def element(number: int, payload: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int, track: int, offset: int, flags: int = 0x80) -> bytes:
    """A block's content; kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    head = vint(track) + struct.pack(">hB", offset, flags | kind << 1)
    if kind == 0:
        return head + frames[0]
    sizes = b""
    if kind == 1:
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        sizes = vint(len(frames[0])) if len(frames) > 1 else b""
        sizes += b"".join(signed_vint(len(b) - len(a)) for a, b in zip(frames, frames[1:-1], strict=False))
    return head + bytes([len(frames) - 1]) + sizes + b"".join(frames)


_HEAD = element(EBML, b"".join([unsigned(EBML_VERSION, 1), unsigned(EBML_READ_VERSION, 1), unsigned(EBML_MAX_ID, 4), unsigned(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), unsigned(DOC_TYPE_VERSION, 4), unsigned(DOC_TYPE_READ_VERSION, 2)]))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, b"".join([
    unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), unsigned(FLAG_LACING, 1), element(CODEC_ID, b"A_PCM/INT/LIT"), unsigned(DEFAULT_DURATION, PACKET * 10**9 // RATE),
    element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)),
])))


def mux(payload: bytes) -> bytes:
    """Media whose samples are ``payload``, of a positive multiple of PACKET bytes."""
    n = len(payload) // PACKET
    if not n or len(payload) % PACKET:
        raise ValueError("payload is not whole packets")
    ms = PACKET * 1000 // RATE
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 10**6) + element(DURATION, struct.pack(">d", n * ms)) + element(MUXING_APP, b"codeloom") + element(WRITING_APP, b"codeloom"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for first in range(0, n, LACE * CLUSTER):
        start, blocks = first * ms, [unsigned(TIMESTAMP, first * ms)]
        for k in range(first, min(n, first + LACE * CLUSTER), LACE):
            count = min(LACE, n - k)
            head = b"\x81" + struct.pack(">hBB", k * ms - start, 0x80 | 2 << 1, count - 1)
            blocks.append(element(SIMPLE_BLOCK, head + payload[k * PACKET : (k + count) * PACKET]))
        cluster = element(CLUSTER_ID, b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """Element id with its marker, and the place behind it."""
    length = 9 - data[at].bit_length()
    if length > 4 or at + length > len(data):
        raise ValueError(f"broken element id at {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, or None for an unknown one, and the place behind it."""
    length = 9 - data[at].bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"broken size at {at}")
    value = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def elements(data: bytes, at: int = 0, end: int | None = None, unknown: bool = False) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of content, end of content, unknown size) of each element in a range."""
    end = len(data) if end is None else end
    while at < end:
        number, body = read_id(data, at)
        if unknown and number in _TOP:
            return
        size, body = read_vint(data, body)
        if size is None:
            stop = body
            inner = _TOP - {CLUSTER_ID} if number == SEGMENT else set()
            while stop < end:
                below, after = read_id(data, stop)
                if below in (_TOP - inner if number != SEGMENT else {SEGMENT, EBML}):
                    break
                length, after = read_vint(data, after)
                stop = end if length is None and number == SEGMENT else after + (length or 0)
            yield number, body, stop, True
            at = stop
            continue
        if body + size > end:
            raise ValueError(f"element at {at} is cut off")
        yield number, body, body + size, False
        at = body + size


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


@dataclass
class Media:
    """What a file holds.  ``packets``: track, timestamp in ns, keyframe, lacing, start, size."""

    doc_type: str = ""
    scale: int = 10**6
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if kind == 0:
        return [end - at], at
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("uneven fixed-size lace")
        return [(end - at) // count] * count, at
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for k in range(count - 1):
            before = at
            value, at = read_vint(data, at)
            if k and value is not None:
                value += sizes[-1] - ((1 << 7 * (at - before) - 1) - 1)
            if value is None or value < 0:
                raise ValueError("broken EBML lace")
            sizes.append(value)
    last = end - at - sum(sizes)
    if last < 0:
        raise ValueError("lace is longer than its block")
    return [*sizes, last], at


def _block(data: bytes, a: int, b: int, time: int, media: Media, key: bool | None) -> None:
    track, a = read_vint(data, a)
    offset, flags = struct.unpack(">hB", data[a : a + 3])
    kind = flags >> 1 & 3
    sizes, at = frame_sizes(data, a + 3, b, kind)
    step = media.tracks.get(track or 0, {}).get("default_duration", 0)
    start = (time + offset) * media.scale
    keyframe = bool(flags & 0x80) if key is None else key
    for i, size in enumerate(sizes):
        media.packets.append((track or 0, start + i * step, keyframe, kind, at, size))
        at += size


def demux(data: bytes) -> Media:
    """Read tracks, packets and cues; sizes and places are bytes from the file's start."""
    media = Media()
    segment = None
    for number, a, b, _ in elements(data):
        if number == EBML:
            for n, c, d, _ in elements(data, a, b):
                if n == DOC_TYPE:
                    media.doc_type = data[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif number == SEGMENT and segment is None:
            segment = (a, b)
    if segment is None:
        raise ValueError("no segment")
    base, stop = segment
    for number, a, b, _ in elements(data, base, stop):
        if number == INFO:
            for n, c, d, _ in elements(data, a, b):
                if n == TIMESTAMP_SCALE:
                    media.scale = _uint(data, c, d)
                elif n == DURATION:
                    media.duration = _float(data, c, d)
        elif number == TRACKS:
            for n, c, d, _ in elements(data, a, b):
                if n == TRACK_ENTRY:
                    _track(data, c, d, media)
        elif number == CLUSTER_ID:
            media.clusters.append(a)
            time = 0
            for n, c, d, _ in elements(data, a, b):
                if n == TIMESTAMP:
                    time = _uint(data, c, d)
                elif n == SIMPLE_BLOCK:
                    _block(data, c, d, time, media, None)
                elif n == BLOCK_GROUP:
                    inner = list(elements(data, c, d))
                    for m, e, f, _ in inner:
                        if m == BLOCK:
                            _block(data, e, f, time, media, all(x[0] != REFERENCE_BLOCK for x in inner))
        elif number == CUES:
            for n, c, d, _ in elements(data, a, b):
                if n == CUE_POINT:
                    time, spots = 0, []
                    for m, e, f, _ in elements(data, c, d):
                        if m == CUE_TIME:
                            time = _uint(data, e, f)
                        elif m == CUE_TRACK_POSITIONS:
                            got = {x: _uint(data, g, h) for x, g, h, _ in elements(data, e, f)}
                            spots.append((got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time * media.scale, track, at) for track, at in spots]
    return media


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    track: dict = {}
    for n, c, d, _ in elements(data, a, b):
        if n == TRACK_NUMBER:
            track["number"] = _uint(data, c, d)
        elif n == TRACK_TYPE:
            track["type"] = _uint(data, c, d)
        elif n == CODEC_ID:
            track["codec"] = data[c:d].decode("ascii", "replace")
        elif n == DEFAULT_DURATION:
            track["default_duration"] = _uint(data, c, d)
        elif n == AUDIO:
            for m, e, f, _ in elements(data, c, d):
                if m == SAMPLING_FREQUENCY:
                    track["rate"] = _float(data, e, f)
                elif m in (CHANNELS, BIT_DEPTH):
                    track["channels" if m == CHANNELS else "bits"] = _uint(data, e, f)
    media.tracks[track.get("number", 0)] = track


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, one after the other in order of time."""
    spots = sorted((p[1], p[4], p[5]) for p in media.packets if p[0] == track)
    runs: list[list[int]] = []
    for _, at, size in spots:
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return b"".join(data[a:b] for a, b in runs)


def features(payload: bytes, media: Media) -> str:
    """Packets, clusters, cues, milliseconds, then of the samples: mean and deviation in
    hundredths, crossings of the middle in 10,000, and the share of 8 levels in 1,000."""
    a = np.frombuffer(payload, np.uint8)
    n = len(a)
    levels = np.bincount(a >> 5, minlength=8)
    counts = np.bincount(a, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    spread = int(100 * max(0, squares * n - total * total) ** 0.5) // n
    crossings = int(np.count_nonzero((a[1:] ^ a[:-1]) & 0x80)) if n > 1 else 0
    values = [len(media.packets), len(media.clusters), len(media.cues), int(media.duration), 100 * total // n, spread, 10_000 * crossings // n, *(1000 * int(x) // n for x in levels)]
    return ",".join(map(str, values))


def padded(text: bytes | None) -> bytes:
    """The text's bytes, with spaces up to a positive multiple of PACKET."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // PACKET)) * PACKET, b" ")


def stored(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_bytes and media: each text as media."""

    def make():
        def run(texts):
            return {"n_bytes": [len(t or b"") for t in texts], "media": [mux(padded(t)) for t in texts]}

        return run

    return common.map_texts(docs, keep, text, make, pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())]), "n_bytes bigint, media binary")


def described(table: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep`` and what is read from media: samples' length and digests, the media's, features."""
    fields = [("payload_bytes", pa.int64(), "bigint"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "bigint"), ("media_bytes", pa.int64(), "bigint"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]

    def make():
        def run(column):
            rows = []
            for data in column:
                found = demux(data)
                back = samples(data, found)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(back, found)))
            return dict(zip([f[0] for f in fields], zip(*rows, strict=True), strict=True))

        return run

    return common.map_texts(table, keep, media, make, pa.schema([f[:2] for f in fields]), ", ".join(f"{n} {s}" for n, _, s in fields))


def packets(table: DataFrame, key: str, media: str = "media") -> DataFrame:
    """The packet table: key, track, codec, number, timestamp_ns, keyframe, lacing, start, size,
    cued (a cue points to the packet's cluster), error."""
    common.ship(table.sparkSession)
    head = f"`{key}` {table.schema[key].dataType.simpleString()}"
    names = ["track", "codec", "number", "timestamp_ns", "keyframe", "lacing", "start", "size", "cued", "error"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is None:
                    continue
                try:
                    m = demux(data)
                    starts = sorted(m.clusters)
                    # a cue gives the element's place: its content begins within 12 bytes
                    cued = {c for c in starts if any(c - 12 <= at < c for _, _, at in m.cues)}
                    owner = np.searchsorted(starts, [p[4] for p in m.packets], "right") - 1
                    rows = [(p[0], m.tracks.get(p[0], {}).get("codec"), k, p[1], p[2], ("none", "xiph", "fixed", "ebml")[p[3]], p[4], p[5], starts[owner[k]] in cued, None) for k, p in enumerate(m.packets)]
                except (ValueError, IndexError, struct.error) as error:
                    rows = [(None,) * 9 + (str(error) or "cut off",)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                keys = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, *names])

    return table.select(key, media).mapInArrow(run, f"{head}, track int, codec string, number bigint, timestamp_ns bigint, keyframe boolean, lacing string, start bigint, size bigint, cued boolean, error string")


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = common.written(stored(common.documents(spark, sf_dir, "doc_id", "text"), ["doc_id"]), "media")
    return described(media, ["doc_id", "n_bytes"])
