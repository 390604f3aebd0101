"""Media columns as FLAC: lossless 8-bit mono streams, written and read back in numpy.

Encoding cuts the samples into frames of 576, predicts each frame with a constant, a fixed polynomial of order 0 to 4 or a
two-tap linear predictor (whichever leaves the least residual), and writes Rice codes in four partitions. Every frame has
its CRC-8 and CRC-16; the stream has STREAMINFO with the MD5 of the samples and a SEEKTABLE with a point for each frame. A
SEEKTABLE holds at most ``POINTS`` points: of a longer stream it has every second frame, or every third and so on, and
APPLICATION blocks have the sizes of all frames.
Decoding finds the frames by these, verifies both checksums of each, decodes Rice residuals and predictors of all
frames of a chunk side by side, and verifies the MD5. ``read_samples`` seeks: it reads and verifies only the frames that hold
the samples asked for, whatever the rest. ``pcm_blocks`` gives the samples in blocks with their offsets, a chunk at a time.

At most ``CHUNK`` frames are held as bits at a time, whatever the length of a text. Null text counts as empty; an empty text
is one frame of padding. Repeated rows stay; an empty table gives an empty result; only doc_id and text are read. Damaged
streams raise ``CorruptStream``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import map_batches, map_stream, table

FRAME, RATE, PARTS, CHUNK, PAD = 576, 8000, 2, 2048, 255
POINTS, SIZES = ((1 << 24) - 1) // 18, 1 << 23  # of a SEEKTABLE, and frame sizes of an APPLICATION block: what 24 bits of length allow
_POINT = np.dtype([("sample", ">u8"), ("byte", ">u8"), ("size", ">u2")])
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])
_SHIFT, _PRECISION = 6, 9  # of the two-tap predictor's coefficients


class CorruptStream(ValueError):
    """A stream that fails a checksum or isn't of the form written here."""


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = ((crc << 1) ^ np.where(crc >> (bits - 1) & 1, polynomial, 0)) & ((1 << bits) - 1)
    return crc.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc8(raw: bytes) -> int:
    crc = 0
    for b in raw:
        crc = int(_CRC8[crc ^ b])
    return crc


def _crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, side by side."""
    crc = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    at, left, got = start[order], size[order], crc
    live = len(order)
    for i in range(int(size.max(initial=0))):
        while live and left[live - 1] <= i:
            live -= 1
        c = got[:live]
        got[:live] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[at[:live] + i]]
    out = np.empty_like(got)
    out[order] = got
    return out


def _coded_number(n: int) -> bytes:
    """Frame number in the UTF-8 manner, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    return bytes([(0xFF << (7 - more)) & 0xFF | n >> (6 * more)] + [0x80 | n >> (6 * i) & 0x3F for i in range(more - 1, -1, -1)])


def _header(n: int) -> bytes:
    raw = b"\xff\xf8\x24\x02" + _coded_number(n)  # fixed blocks of 576, 8 kHz, mono, 8 bits
    return raw + bytes([_crc8(raw)])


def _predict(s: np.ndarray):
    """Order, coefficients, shift and residuals of the best predictor of each frame."""
    n = len(s)
    order, coef, shift = np.zeros(n, np.int64), np.zeros((n, 4), np.int64), np.zeros(n, np.int64)
    best, best_cost, d = s.copy(), np.abs(s).sum(1), s
    for o in range(1, 5):
        d = np.diff(d, axis=1)
        cost = np.abs(d).sum(1) + 8 * o
        better = cost < best_cost
        best_cost = np.where(better, cost, best_cost)
        order[better], coef[better] = o, _FIXED[o]
        best[better, o:] = d[better]
    x, a, b = (v.astype(np.float32) for v in (s[:, 2:], s[:, 1:-1], s[:, :-2]))
    aa, bb, ab, xa, xb = (np.einsum("ij,ij->i", p, q).astype(np.float64) for p, q in ((a, a), (b, b), (a, b), (x, a), (x, b)))
    det = aa * bb - ab * ab
    safe = np.where(det > 0, det, 1)
    c = np.stack([(xa * bb - xb * ab) / safe, (xb * aa - xa * ab) / safe], 1)
    limit = (1 << (_PRECISION - 1)) - 1
    c = np.clip(np.rint(c * (1 << _SHIFT)), -limit, limit).astype(np.int32)
    r = s[:, 2:] - ((c[:, :1] * s[:, 1:-1] + c[:, 1:] * s[:, :-2]) >> _SHIFT)
    linear = (det > 0) & (np.abs(r).sum(1) + 64 < best_cost)
    order[linear], shift[linear] = 2, _SHIFT
    coef[linear, :2], coef[linear, 2:] = c[linear], 0
    best[linear, 2:] = r[linear]
    return order, coef, shift, best, linear


def _encode_chunk(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    s = samples.astype(np.int32)
    n = len(s)
    order, coef, shift, res, linear = _predict(s)
    constant = (s == s[:, :1]).all(1)
    heads = [_header(k) for k in numbers]
    wide = max(map(len, heads))
    head = np.zeros((n, wide), np.int64)
    head_size = np.fromiter(map(len, heads), np.int64, n)
    for i, h in enumerate(heads):
        head[i, : len(h)] = list(h)
    fields, sizes = [head], [np.where(np.arange(wide) < head_size[:, None], 8, 0)]

    def put(value, size) -> None:
        fields.append(np.broadcast_to(np.asarray(value), (n,))[:, None])
        sizes.append(np.broadcast_to(np.asarray(size), (n,))[:, None])

    coded = ~constant
    put(np.where(constant, 0, np.where(linear, 32 | 1, 8 | order)) << 1, 8)
    put(s[:, 0] & 255, np.where(constant, 8, 0))
    for j in range(4):
        put(s[:, j] & 255, np.where(coded & (j < order), 8, 0))
    put(_PRECISION - 1, np.where(coded & linear, 4, 0))
    put(shift, np.where(coded & linear, 5, 0))
    for j in range(2):
        put(coef[:, j] & ((1 << _PRECISION) - 1), np.where(coded & linear, _PRECISION, 0))
    put(PARTS, np.where(coded, 6, 0))  # method 0 and the partition order
    long = FRAME >> PARTS
    for part in range(1 << PARTS):
        block = res[:, part * long : (part + 1) * long]
        used = coded[:, None] & (np.arange(part * long, (part + 1) * long) >= order[:, None])
        u = np.where(used, np.where(block < 0, -2 * block - 1, 2 * block), 0)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / np.maximum(used.sum(1), 1), 1))), 0, 14).astype(np.int32)
        put(k, np.where(coded, 4, 0))
        # the zeros of the quotient stand before a field; only the stop bit and the remainder are written
        fields.append((1 << k)[:, None] | u & ((1 << k) - 1)[:, None])
        sizes.append(np.where(used, (u >> k[:, None]) + 1 + k[:, None], 0))
    value, size = np.concatenate(fields, 1), np.concatenate(sizes, 1)
    total = size.sum(1)
    whole = -(-total // 8)
    begin = np.cumsum(whole) - whole
    end = (np.cumsum(size, axis=1) + 8 * begin[:, None]).ravel()
    value, size = value.ravel(), size.ravel()
    bits = np.zeros(8 * int(whole.sum()), np.uint8)
    written = np.flatnonzero(size)
    value, end = value[written], end[written]
    for j in range(int(value.max()).bit_length()):
        bits[end[(value >> j & 1).astype(bool)] - 1 - j] = 1
    data = np.packbits(bits)
    crc, raw = _crc16(data, begin, whole), data.tobytes()
    return [raw[a : a + w] + c.to_bytes(2, "big") for a, w, c in zip(begin.tolist(), whole.tolist(), crc.tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of 576 bytes; sample = byte - 128."""
    counts = [len(p) // FRAME for p in payloads]
    frames: list[bytes] = []
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    numbers = [i for c in counts for i in range(c)]
    for a in range(0, len(numbers), CHUNK):
        frames += _encode_chunk(joined[a : a + CHUNK].astype(np.int16) - 128, numbers[a : a + CHUNK])
    out, at = [], 0
    for p, c in zip(payloads, counts):
        own = frames[at : at + c]
        at += c
        sizes = [len(f) for f in own]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", FRAME, FRAME) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        each, at_byte = -(-c // POINTS), np.cumsum([0, *sizes[:-1]])
        seek = np.zeros(-(-c // each), _POINT)
        seek["sample"], seek["byte"], seek["size"] = np.arange(0, c, each) * FRAME, at_byte[::each], FRAME
        blocks = [(0, info), *((2, b"elSZ" + np.array(sizes[a : a + SIZES - 2], ">u2").tobytes()) for a in (range(0, c, SIZES - 2) if each > 1 else ())), (3, seek.tobytes())]
        heads = (bytes([kind | 128 * (i == len(blocks) - 1)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(blocks))
        out.append(b"fLaC" + b"".join(heads) + b"".join(own))
    return out


def _open(stream: bytes):
    """(samples, md5, starts and sizes of the frames) from a stream's metadata."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no FLAC marker")
    at, last, total, md5, seek, sizes = 4, False, 0, b"", None, []
    while not last:
        if at + 4 > len(stream):
            raise CorruptStream("metadata ends early")
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            raise CorruptStream("metadata ends early")
        if kind == 0:
            if struct.unpack(">HH", body[:4]) != (FRAME, FRAME):
                raise CorruptStream("blocks aren't of 576 samples")
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        elif kind == 2 and body[:4] == b"elSZ":
            sizes.append(np.frombuffer(body[4:], ">u2"))
        elif kind == 3:
            seek = np.frombuffer(body, _POINT)
    frames = total // FRAME
    if seek is None or not len(seek) or total % FRAME:
        raise CorruptStream("no seek points")
    if sizes:
        length = np.concatenate(sizes).astype(np.int64)
        start = np.cumsum(length) - length
        each = -(-frames // len(seek))
        if len(length) != frames or not np.array_equal(seek["byte"], start[::each]):
            raise CorruptStream("seek points and frame sizes disagree")
    else:
        if len(seek) != frames:
            raise CorruptStream("no seek point for each frame")
        start = seek["byte"].astype(np.int64)
        length = np.append(start[1:], len(stream) - at) - start
    if (length < 8).any() or start[-1] + length[-1] + at > len(stream):
        raise CorruptStream("a frame's place")
    return total, md5, start + at, length


def _decode_chunk(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(start)
    if (size < 8).any() or (_crc16(data, start, size - 2) != data[start + size - 2].astype(np.uint32) * 256 + data[start + size - 1]).any():
        raise CorruptStream("CRC-16 of a frame")
    bits = np.unpackbits(data)
    one = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    one = np.append(np.minimum.accumulate(one[::-1])[::-1], [len(bits)] * 64).astype(np.int32)
    wide = np.append(data, [0, 0, 0]).astype(np.int32)
    wide = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]

    def read(pos, k):
        return (wide.take(pos >> 3, mode="clip") >> (24 - (pos & 7) - k)) & ((1 << k) - 1)

    def signed(v, k):
        return v - ((v >> (k - 1)) << k)

    eight, four = np.full(n, 8, np.int32), np.full(n, 4, np.int32)
    if (data[start[:, None] + np.arange(4)] != np.frombuffer(b"\xff\xf8\x24\x02", np.uint8)).any():
        raise CorruptStream("a frame's header")
    lead = data[start + 4]
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    crc = np.zeros(n, np.uint32)
    for i in range(5 + int(more.max(initial=0))):
        crc = np.where(i < 5 + more, _CRC8[crc ^ data[start + i]], crc)
    if (crc != data[start + 5 + more]).any():
        raise CorruptStream("CRC-8 of a frame's header")
    pos = (8 * (start + 6 + more)).astype(np.int32)
    kind = read(pos, eight) >> 1
    pos = pos + 8
    constant, linear = kind == 0, kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    if not (constant | fixed | (linear & (order <= 4))).all():
        raise CorruptStream("a kind of subframe that isn't written here")
    out = np.zeros((4 + FRAME, n), np.int32)  # by sample; four zeros before the first
    value = signed(read(pos, eight), 8)
    warm = np.zeros((4, n), np.int32)
    for j in range(4):
        has = j < order
        warm[j] = signed(read(pos, eight), 8)
        pos = np.where(has, pos + 8, pos)
    coef, shift = _FIXED[np.where(linear, 0, order)].copy(), np.zeros(n, np.int64)
    precision = np.where(linear, read(pos, four) + 1, 1)
    pos = np.where(linear, pos + 4, pos)
    shift = np.where(linear, read(pos, np.full(n, 5)), 0)
    pos = np.where(linear, pos + 5, pos)
    for j in range(4):
        has = linear & (j < order)
        coef[:, j] = np.where(has, signed(read(pos, precision), precision), coef[:, j])
        pos = np.where(has, pos + precision, pos)
    if ((read(pos, np.full(n, 6)) != PARTS) & ~constant).any():
        raise CorruptStream("Rice partitions")
    pos = pos + 6
    long, k = FRAME >> PARTS, four
    widest = int(np.where(constant, 0, order).max(initial=0))
    pos, coef, shift, order = pos.astype(np.int32), np.ascontiguousarray(coef.T.astype(np.int32)), shift.astype(np.int32), order.astype(np.int32)
    for i in range(FRAME):
        if i % long == 0:
            k = read(pos, four)
            pos = pos + four
        after = one.take(pos, mode="clip")
        u = (after - pos) << k
        after += 1
        u |= read(after, k)
        r = (u >> 1) ^ -(u & 1)
        if widest:
            guess = coef[0] * out[3 + i]
            for j in range(1, widest):
                guess += coef[j] * out[3 + i - j]
            r += guess >> shift
        after += k
        if i < 4:
            coded = i >= order
            out[4 + i] = np.where(coded, r, warm[i])
            pos = np.where(coded, after, pos)
        else:
            out[4 + i] = r
            pos = after
    out = out[4:].T
    out[constant] = value[constant, None]
    return out


def _decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples of frames that follow each other in ``data``, a chunk at a time."""
    got = np.empty((len(start), FRAME), np.int8)
    for a in range(0, len(start), CHUNK):
        s, z = start[a : a + CHUNK], size[a : a + CHUNK]
        low, high = int(s[0]), int(s[-1] + z[-1])
        chunk = _decode_chunk(data[low:high], s - low, z)
        if chunk.min() < -128 or chunk.max() > 127:
            raise CorruptStream("a sample out of range")
        got[a : a + CHUNK] = chunk
    return got.ravel()


def decode(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams; every checksum is verified."""
    heads = [_open(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    start = np.concatenate([h[2] + b for h, b in zip(heads, base)]) if heads else np.zeros(0, np.int64)
    size = np.concatenate([h[3] for h in heads]) if heads else start
    flat, at, out = _decode_frames(np.frombuffer(b"".join(streams), np.uint8), start, size), 0, []
    for total, md5, *_ in heads:
        own = flat[at : at + total]
        at += total
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise CorruptStream("MD5 of the samples")
        out.append((own.view(np.uint8) ^ 128).tobytes())
    return out


def read_samples(stream: bytes, first: int, count: int, head=None) -> bytes:
    """``count`` bytes of the payload from ``first`` on, fewer at its end; only their frames are read and verified."""
    total, _, start, size = head or _open(stream)
    first, end = max(0, first), min(total, first + count)
    if first >= end:
        return b""
    a, b = first // FRAME, -(-end // FRAME)
    own = _decode_frames(np.frombuffer(stream, np.uint8), start[a:b], size[a:b])[first - a * FRAME : end - a * FRAME]
    return (own.view(np.uint8) ^ 128).tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def _feature(payload: bytes) -> str:
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"mean={s.sum()}/{len(s)};energy={(s * s).sum()};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def _runs(texts: list[str | None]):
    run, size = [], 0
    for t in texts:
        run.append(payload_of(t))
        size += len(run[-1][0])
        if size >= CHUNK * FRAME:
            yield run
            run, size = [], 0
    if run:
        yield run


def media_columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The contract's columns; with ``keep`` also the stream itself as ``media``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, streams = [], []
        for group in _runs(batch.column(1).to_pylist()):
            media = encode([p for p, _ in group])
            for (p, n), m, back in zip(group, media, decode(media)):
                rows.append({"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": _feature(back)})
                streams += [m] if keep else []
        cols = [pa.array([r[c] for r in rows], t) for c, t in _COLUMNS]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols] + ([pa.array(streams, pa.binary())] if keep else []), names=["doc_id", *(c for c, _ in _COLUMNS)] + ["media"] * keep)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select("doc_id", "text"), run, schema + ", media binary" * keep)


_COLUMNS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: the samples of (doc_id, media) in blocks of 576, one row for each."""

    def run(batches):
        for b in batches:
            for doc_id, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stream is None:
                    continue
                head = _open(stream)
                for first in range(0, head[0], CHUNK * FRAME):
                    raw = read_samples(stream, first, CHUNK * FRAME, head)
                    at = range(0, len(raw), FRAME)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), b.schema.field(0).type), pa.array([first + a for a in at], pa.int64()), pa.array([raw[a : a + FRAME] for a in at], pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return map_stream(media.select("doc_id", "media"), run, f"doc_id {dict(media.dtypes)['doc_id']}, sample_offset long, pcm binary")


def op4_media_columns(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))


def media_payload(spark, sf_dir):
    """The part of op4 that SQL can express: sizes and digest of what is read back from the streams."""
    return op4_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_PAYLOAD_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 575) // 576) * 576 AS whole FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, whole::BIGINT AS payload_bytes, sha256(raw || repeat('\xFF'::BLOB, whole - n)) AS payload_sha256 FROM p
"""
