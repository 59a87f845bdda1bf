"""Media columns: motion JPEG in AVI, stored, parsed, decoded and cut into timed clips.

A payload is stored in gray 24 x 24 baseline JPEG frames, 576 bytes each. The format's unit is the
quantised DCT coefficient: a byte is the eight additional bits of a coefficient of category 8
(-255..-128, 128..255), so entropy decoding gives it back exactly. Both Huffman tables hold the one
symbol needed, a restart marker resets the DC predictor at each block. Any baseline decoder reads
such frames; frames of other baseline gray encoders are read as well, by the general decoder here.

Reading parses the RIFF tree and the idx1 index, checks every index entry against its chunk and
decodes each (intra) frame. Shots are detected by the difference of consecutive 16-bin histograms:
a cut is a difference over a floor and over mean + SPREAD deviations of the differences around it.

Defined cases: null text is an empty payload, which is stored as one frame of padding; equal texts
give equal media; media of another encoder hold no payload, so n_bytes and the payload columns are
null and the rest is filled; null media are not allowed; other columns are ignored; an empty table
gives no rows; a payload's RIFF must stay under 4 GB (Spark's own limit for a value is 2 GB), and a
value is worked on whole; equal differences at a cut are no tie, since each frame is judged alone;
one-frame media are one clip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

UNIT, SIDE, FPS = 576, 24, 25
FLOOR, SPREAD, AROUND = 0.25, 2.5, 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15) + b"\x08"  # one code of one bit, for the symbol (run 0, category 8)
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, b"\x00\x01")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
_BLOCKS, _BLOCK = UNIT // 64, 72
_DATA = _BLOCKS * _BLOCK + 2 * (_BLOCKS - 1)
_FRAME = len(HEADER) + _DATA + 2
_CHUNK = 8 + _FRAME


def padded(text: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def frames_of(units: np.ndarray) -> np.ndarray:
    """(frames, 576) bytes -> (frames, chunk) AVI chunks with a JPEG each, before byte stuffing."""
    n = len(units)
    bits = np.zeros((n * UNIT, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(units.reshape(-1, 1), axis=1)
    coded = np.packbits(bits.reshape(-1)).reshape(n, _BLOCKS, _BLOCK)
    out = np.empty((n, _CHUNK), np.uint8)
    out[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _FRAME), np.uint8)
    out[:, 8 : 8 + len(HEADER)] = np.frombuffer(HEADER, np.uint8)
    data = np.empty((n, _BLOCKS, _BLOCK + 2), np.uint8)
    data[:, :, :_BLOCK] = coded
    data[:, :, _BLOCK] = 0xFF
    data[:, :, _BLOCK + 1] = 0xD0 + np.arange(_BLOCKS, dtype=np.uint8) % 8
    out[:, 8 + len(HEADER) : -2] = data.reshape(n, -1)[:, :-2]
    out[:, -2:] = (0xFF, 0xD9)
    return out


def _stuffed(chunk: bytes) -> bytes:
    """The chunk with a zero byte after each 255 of entropy-coded data, of even length."""
    lo = 8 + len(HEADER)
    parts = []
    for k in range(_BLOCKS):
        at = lo + k * (_BLOCK + 2)
        parts.append(chunk[at : at + _BLOCK].replace(b"\xff", b"\xff\x00") + (chunk[at + _BLOCK : at + _BLOCK + 2] if k < _BLOCKS - 1 else b""))
    body = HEADER + b"".join(parts) + b"\xff\xd9"
    return b"00dc" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(movi: bytes, sizes: np.ndarray, n_bytes: int) -> bytes:
    """A RIFF file around the chunks of `movi`, whose sizes without header are given; n_bytes is the payload's length before padding."""
    n = len(sizes)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, int(sizes.max()), -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", n_bytes))))
    index = np.empty((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    steps = sizes + sizes % 2 + 8
    index[:, 2] = 4 + np.cumsum(steps) - steps
    index[:, 3] = sizes
    body = b"AVI " + hdrl + _list(b"movi", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(texts: list[bytes]) -> list[bytes]:
    payloads = [padded(t) for t in texts]
    chunk = frames_of(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    data = chunk[:, 8 + len(HEADER) : -2]
    full = (data == 0xFF).sum(axis=1) > _BLOCKS - 1
    ends = np.cumsum([len(p) // UNIT for p in payloads]).tolist()
    out, lo = [], 0
    for t, hi in zip(texts, ends, strict=True):
        sizes = np.full(hi - lo, _FRAME, np.int64)
        parts, at = [], lo
        for k in (np.flatnonzero(full[lo:hi]) + lo).tolist():
            one = _stuffed(chunk[k].tobytes())
            parts += [chunk[at:k].tobytes(), one]
            sizes[k - lo] = struct.unpack_from("<I", one, 4)[0]
            at = k + 1
        parts.append(chunk[at:hi].tobytes())
        out.append(avi(b"".join(parts), sizes, len(t)))
        lo = hi
    return out


def riff_index(media: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(payload length, (place, size) of each frame's JPEG), from the RIFF tree and idx1, entry by entry checked against its chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    n_bytes, movi, index = -1, None, None
    stack = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    stack.append((at + 12, at + 8 + size))
            elif name == b"strd" and size == 8:
                n_bytes = struct.unpack_from("<Q", media, at + 8)[0]
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for offset, size in index[:, 2:].tolist():
        if media[movi + offset : movi + offset + 4] != b"00dc" or struct.unpack_from("<I", media, movi + offset + 4)[0] != size:
            raise ValueError("index and chunks differ")
        out.append((movi + offset + 8, size))
    return n_bytes, out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("entropy-coded data ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")


def _extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def decode_coefficients(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(blocks x 64 quantised coefficients in scan order, quantisation table, width, height) of a baseline gray JPEG."""
    at, tables, quant, every, width, height, q = 2, {}, {}, 0, 0, 0, 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for n, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("gray frames only")
            q = body[8]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("baseline frames only")
    end, blocks = jpeg.rindex(b"\xff\xd9"), -(-width // 8) * -(-height // 8)
    parts, lo, k = [], at, at
    while (k := jpeg.find(b"\xff", k, end)) >= 0:
        if 0xD0 <= jpeg[k + 1] <= 0xD7:
            parts.append(jpeg[lo:k])
            lo = k + 2
        k += 2
    parts.append(jpeg[lo:end])
    out, n = np.zeros((blocks, 64), np.int64), 0
    for part in parts:
        bits, before = _Bits(part.replace(b"\xff\x00", b"\xff")), 0
        for _ in range(every or blocks):
            if n == blocks:
                break
            size = bits.symbol(dc)
            before += _extend(bits.take(size), size)
            out[n, 0], k = before, 1
            while k < 64:
                run, size = divmod(bits.symbol(ac), 16)
                if not size:
                    if run < 15:
                        break
                    k += 16
                    continue
                k += run
                out[n, k] = _extend(bits.take(size), size)
                k += 1
            n += 1
    return out, quant[q], width, height


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([x * 8 + y for x, y in order])


def _basis() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


def pixels(coefficients: np.ndarray, quant: np.ndarray, width: int, height: int) -> np.ndarray:
    """Samples 0..255 of a frame, by the inverse DCT."""
    basis = _basis()
    blocks = np.zeros((len(coefficients), 64))
    blocks[:, _zigzag()] = coefficients * quant
    flat = np.einsum("ux,nuv,vy->nxy", basis, blocks.reshape(-1, 8, 8), basis) + 128
    across = -(-width // 8)
    image = flat.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)
    return np.clip(np.rint(image[:height, :width]), 0, 255).astype(np.uint8)


def _own(jpeg: bytes) -> bytes | None:
    """A frame of frames_of() without byte stuffing, or None."""
    if not jpeg.startswith(HEADER):
        return None
    if len(jpeg) != _FRAME:
        jpeg = HEADER + jpeg[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") + jpeg[-2:]
    return jpeg if len(jpeg) == _FRAME else None


def units_of(jpeg: np.ndarray) -> np.ndarray:
    """(frames, frame bytes) of our own frames, without stuffing -> (frames, 576) bytes."""
    n = len(jpeg)
    if (jpeg[:, : len(HEADER)] != np.frombuffer(HEADER, np.uint8)).any():
        raise ValueError("another encoder's header")
    data = np.concatenate([jpeg[:, len(HEADER) : -2], np.zeros((n, 2), np.uint8)], axis=1).reshape(n, _BLOCKS, _BLOCK + 2)
    bits = np.unpackbits(np.ascontiguousarray(data[:, :, :_BLOCK]).reshape(-1)).reshape(-1, 9)
    if bits[:, 0].any():
        raise ValueError("no such Huffman code")
    return np.packbits(bits[:, 1:].reshape(-1)).reshape(n, UNIT)


def histograms_of(units: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(frames, 16) counts of the samples of our own frames, as pixels() decodes them, in batches."""
    inverse = np.asarray(quant).reshape(-1, 1) * np.kron(_basis(), _basis())[_zigzag()]
    out = [np.zeros((0, 16), np.int64)]
    for lo in range(0, len(units), 1024):
        part = units[lo : lo + 1024].astype(np.float64)
        samples = np.rint(np.where(part < 128, part - 255, part).reshape(-1, 64) @ inverse + 128)
        shade = np.clip(samples, 0, 255).astype(np.int64).reshape(len(part), -1) >> 4
        out.append(np.bincount((np.arange(len(part))[:, None] * 16 + shade).reshape(-1), minlength=16 * len(part)).reshape(-1, 16))
    return np.concatenate(out)


def shots(histograms: np.ndarray) -> list[int]:
    """The frames that begin a shot, 0 first."""
    if len(histograms) < 2:
        return [0]
    total = histograms[0].sum()
    d = np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1) / (2 * total)
    one, two = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    lo = np.maximum(np.arange(len(d)) - AROUND, 0)
    hi = np.minimum(np.arange(len(d)) + AROUND + 1, len(d))
    n = hi - lo - 1  # all around but the difference itself
    mean = (one[hi] - one[lo] - d) / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / np.maximum(n, 1) - mean * mean, 0))
    cut = (d > FLOOR) & ((n == 0) | (d > mean + SPREAD * deviation))
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def decode(media: list[bytes]) -> list[tuple[int | None, bytes | None, list[int], int]]:
    """(length before padding, payload, first frames of the shots, frames) of each; frames of another encoder hold no payload, so both are None."""
    parsed = [riff_index(m) for m in media]
    standard, foreign = [], {}
    for i, (m, (_, frames)) in enumerate(zip(media, parsed, strict=True)):
        own = [_own(m[at : at + size]) for at, size in frames]
        if None in own:
            foreign[i] = np.stack([np.bincount(pixels(*decode_coefficients(m[at : at + size])).reshape(-1) >> 4, minlength=16) for at, size in frames])
        else:
            standard.append(b"".join(own))
    flat = np.frombuffer(b"".join(standard), np.uint8).reshape(-1, _FRAME)
    units = units_of(flat) if len(flat) else np.zeros((0, UNIT), np.uint8)
    histograms = histograms_of(units, decode_coefficients(frames_of(np.zeros((1, UNIT), np.uint8))[0, 8:].tobytes())[1])
    out, lo = [], 0
    for i, (n_bytes, frames) in enumerate(parsed):
        if i in foreign:
            out.append((None, None, shots(foreign[i]), len(frames)))
            continue
        hi = lo + len(frames)
        out.append((n_bytes, units[lo:hi].tobytes(), shots(histograms[lo:hi]), len(frames)))
        lo = hi
    return out


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of docs(doc_id, text, ...): the whole text as an AVI value."""

    def run(batches):
        for b in batches:
            for lo, hi in sliced(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(encode(b.column(1).slice(lo, hi - lo).to_pylist()), pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What media(doc_id, media) holds, all of it read back from the stored bytes."""

    def run(batches):
        for b in batches:
            for lo, hi in sliced(b.column(1)):
                rows, values = [], b.column(1).slice(lo, hi - lo).to_pylist()
                for m, (n, payload, cuts, frames) in zip(values, decode(values), strict=True):
                    held = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
                    rows.append((n, *held, len(m), hashlib.sha256(m).hexdigest(), f"frames={frames};shots={len(cuts)};at={','.join(map(str, cuts))}"))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, frames, start_ms, end_ms) of media(doc_id, media)."""

    def run(batches):
        for b in batches:
            for lo, hi in sliced(b.column(1)):
                rows, (ids, values) = [], (b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                for i, (_, _, cuts, frames) in zip(ids, decode(values), strict=True):
                    for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], frames], strict=True)):
                        rows.append((i, k, a, z - a, a * 1000 // FPS, z * 1000 // FPS))
                names = ["doc_id", "clip", "first_frame", "frames", "start_ms", "end_ms"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_ms long, end_ms long")
