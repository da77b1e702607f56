import hashlib
import random
import zlib

import pytest

from codeloom.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 64, 192 * 64 * 16 + 1, 500_000])
def test_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = m.padded(text)
    assert len(payload) % 192 == 0 and payload.startswith(text) and set(payload[n:]) <= {32}
    media = m.mux(payload)
    found = m.demux(media)
    assert m.samples(media, found) == payload
    assert found.doc_type == "matroska" and found.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert len(found.packets) == len(payload) // 192 and len(found.cues) == len(found.clusters)
    assert [p[1] for p in found.packets] == [k * 24_000_000 for k in range(len(found.packets))]
    assert all(media[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in found.cues)


def walk(data):
    """(id, content) of elements, by the specification's rules for sizes and nothing of the module."""
    at = 0
    while at < len(data):
        first = f"{data[at]:08b}".index("1") + 1
        name, at = data[at : at + first].hex(), at + first
        width = f"{data[at]:08b}".index("1") + 1
        size = int("".join(f"{b:08b}" for b in data[at : at + width])[width:], 2)
        at += width
        yield name, data[at : at + size]
        at += size


@pytest.mark.parametrize("n", [1, 192 * 64, 192 * 64 * 16 + 5])
def test_an_independent_reader_finds_the_samples(n):
    payload = m.padded(random.Random(n).randbytes(n))
    top = list(walk(m.mux(payload)))
    assert [name for name, _ in top] == ["1a45dfa3", "18538067"]
    assert dict(walk(top[0][1]))["4282"] == b"matroska"
    frames, times = [], []
    for name, content in walk(top[1][1]):
        if name == "1654ae6b":
            ((_, entry),) = walk(content)
            track = dict(walk(entry))
            assert (track["d7"], track["86"]) == (b"\x01", b"A_PCM/INT/LIT") and dict(walk(track["e1"]))["6264"] == b"\x08"
        if name == "1f43b675":
            (start,) = [int.from_bytes(c, "big") for x, c in walk(content) if x == "e7"]
            for x, block in walk(content):
                if x == "a3":
                    assert block[0] == 0x81 and block[3] & 6 == 4  # track 1, frames of one size
                    count = block[4] + 1
                    size, rest = divmod(len(block) - 5, count)
                    assert rest == 0
                    times.append(start + int.from_bytes(block[1:3], "big", signed=True))
                    frames += [block[5 + k * size : 5 + (k + 1) * size] for k in range(count)]
    assert b"".join(frames) == payload and times == sorted(times) and {len(f) for f in frames} == {192}


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacing(kind):
    frames = [b"a" * 300, b"b" * 255, b"c" * 3, b"d" * 9000, b"e"] if kind in (1, 3) else [b"ab", b"cd", b"ef"]
    frames = frames[:1] if kind == 0 else frames
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.lace(frames, kind, 1, -5, 0)) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    simple = m.element(m.SIMPLE_BLOCK, m.lace(frames, kind, 300, 7))
    body = m.unsigned(m.TIMESTAMP, 100) + m.element(m.VOID, b"xx") + group + simple
    data = m._HEAD + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m._TRACKS + m.CLUSTER_ID.to_bytes(4, "big") + b"\xff" + body + m.element(m.CUES, b"")
    found = m.demux(data)
    assert [data[p[4] : p[4] + p[5]] for p in found.packets] == frames * 2
    assert [p[0] for p in found.packets] == [1] * len(frames) + [300] * len(frames)
    assert found.packets[0][1:4] == (95_000_000, False, kind)
    assert found.packets[-1][2] is True and found.packets[len(frames)][1] == 107_000_000


def test_vints():
    for n in [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**49]:
        assert m.read_vint(m.vint(n), 0)[0] == n
    assert m.read_vint(b"\xff", 0) == (None, 1)


def test_query(spark, make_tables):
    texts = ["abc", None, "", "é" * 400, "abc", "x" * 100_000]
    sf = make_tables(documents=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in m.op2_matroska(spark, sf).collect()}
    for i, t in enumerate(texts):
        payload = m.padded((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(m.mux(payload)).hexdigest() and r.media_bytes > r.payload_bytes
    assert rows[0][1:] == rows[4][1:] and rows[1][1:] == rows[2][1:]


def test_packets(spark):
    media = m.mux(m.padded(b"z" * 20_000))
    table = spark.createDataFrame([(1, media, 0), (2, None, 0), (3, b"\x1a\x45", 0), (4, b"", 0)], "id long, media binary, track int")
    rows = m.packets(table, "id").collect()
    good = [r for r in rows if r.id == 1]
    assert len(good) == 105 and all(r.cued and r.lacing == "fixed" and r.size == 192 for r in good)
    assert b"".join(media[r.start : r.start + r.size] for r in sorted(good, key=lambda r: r.number)) == m.padded(b"z" * 20_000)
    assert {r.id for r in rows if r.error} == {3, 4}
