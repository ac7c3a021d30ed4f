"""Media columns: AVI motion-JPEG (operator 6).

A byte is stored as one flat 8x8 block of a grey baseline JPEG frame: with a DC quantiser of 8 the
block's only coefficient is the sample less 128, so decoding gives the sample back exactly. The
frame's own Huffman table gives a DC category c a code of 9 - c bits (category 0: 9), so that code,
extra bits and end of block are 10 bits for every block, and whole clips are coded and decoded by
array operations. Frames with other tables are decoded symbol by symbol."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, text_buffer

ACROSS, DOWN = 16, 12
UNIT = ACROSS * DOWN
MICROSECONDS = 40_000
PIECE = 1 << 18
#: Frames that are coded, decoded or measured at once.
FRAMES = 4096

_DC_COUNTS, _DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8]) + bytes([1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00]) + _DC_COUNTS + _DC_SYMBOLS)
    + _segment(0xC4, bytes([0x10]) + _AC_COUNTS + _AC_SYMBOLS)
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
_HEAD = np.frombuffer(FRAME_HEAD, np.uint8)


def _ten_bits() -> np.ndarray:
    """Code, extra bits and end of block for each difference from -255 to 255."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        length = 9 - c if c else 9
        code = (1 << length) - 2
        extra = diff if diff > 0 else diff + (1 << c) - 1
        out[diff + 255] = ((code << c) | (extra if c else 0)) << 1
    return out


_CODES = _ten_bits()
_DIFFS = np.zeros(1024, np.int16)
_DIFFS[_CODES.astype(np.int64)] = np.arange(-255, 256)


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AVI frame chunks (`00dc`, length, JPEG, even padding) of frames (n, UNIT), and their n+1 offsets."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    code = _CODES[np.diff(level, axis=1, prepend=np.int16(0)) + 255].reshape(n, UNIT // 4, 4)
    word = code[..., 0] << np.uint64(30) | code[..., 1] << np.uint64(20) | code[..., 2] << np.uint64(10) | code[..., 3]
    scan = np.ascontiguousarray(word.astype(">u8")).view(np.uint8).reshape(n, UNIT // 4, 8)[..., 3:].reshape(n, -1)
    stuffed = scan == 255
    extra = np.cumsum(stuffed, axis=1)
    size = len(_HEAD) + scan.shape[1] + extra[:, -1] + 2
    at = np.concatenate(([0], np.cumsum(8 + size + (size & 1))))
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1, None] + np.arange(8)] = np.frombuffer(b"".join(b"00dc" + struct.pack("<I", s) for s in size.tolist()), np.uint8).reshape(n, 8)
    out[at[:-1, None] + 8 + np.arange(len(_HEAD))] = _HEAD
    begin = at[:-1] + 8 + len(_HEAD)
    out[begin[:, None] + np.arange(scan.shape[1]) + extra - stuffed] = scan
    out[at[:-1, None] + 8 + (size - 2)[:, None] + np.arange(2)] = (255, 0xD9)
    return out, at


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def container(chunks: bytes | memoryview, at: np.ndarray) -> bytes:
    """The AVI file around frame chunks."""
    n = len(at) - 1
    width, height = 8 * ACROSS, 8 * DOWN
    avih = struct.pack("<14I", MICROSECONDS, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, n, 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2] = at[:-1] + 4
    if n:
        raw = np.frombuffer(chunks, np.uint8)
        index[:, 3] = raw[at[:-1, None] + np.arange(4, 8)].copy().view("<u4")[:, 0]
    parts = [b"AVI ", _chunk(b"LIST", hdrl), b"LIST", struct.pack("<I", len(chunks) + 4), b"movi", chunks, _chunk(b"idx1", index.tobytes())]
    return b"".join([b"RIFF", struct.pack("<I", sum(map(len, parts))), *parts])


def parse(media: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Start and length of each video frame by the file's index, and seconds a frame.

    Without an index the movi list is walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, movi_end, index, seconds = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), 0, 0, None, MICROSECONDS / 1e6
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi, movi_end = at + 8, at + 8 + size
        elif name == b"LIST" and kind == b"hdrl" and media[at + 12 : at + 16] == b"avih":
            seconds = struct.unpack_from("<I", media, at + 20)[0] / 1e6
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if index is not None:
        index = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        base = movi if not len(index) or media[movi + int(index[0, 2]) : movi + int(index[0, 2]) + 4] == b"00dc" else 0
        return index[:, 2].astype(np.int64) + base + 8, index[:, 3].astype(np.int64), seconds
    found, at = [], movi + 4
    while movi and at + 8 <= movi_end:
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at + 2 : at + 4] == b"dc":
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    starts, sizes = np.array(found, np.int64).reshape(-1, 2).T
    return starts, sizes, seconds


def decode(media: bytes) -> tuple[np.ndarray, float]:
    """Samples of every frame, one row for a frame, and seconds a frame.

    Frames of this module's own layout give one sample a block; others their luma plane."""
    starts, sizes, seconds = parse(media)
    raw = np.frombuffer(media, np.uint8)
    some = [slice(a, a + FRAMES) for a in range(0, len(starts), FRAMES)]
    if some and all((raw[starts[x, None] + np.arange(len(_HEAD))] == _HEAD).all() for x in some):
        return np.concatenate([_decode_flat(raw, starts[x], sizes[x]) for x in some]), seconds
    frames = [jpeg_luma(media[s : s + n]).reshape(-1) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return (np.stack(frames) if frames else np.zeros((0, UNIT), np.uint8)), seconds


def _decode_flat(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, begin, length = len(starts), starts + len(_HEAD), sizes - len(_HEAD) - 2
    ends = np.cumsum(length)
    scan = raw[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
    kept = np.ones(len(scan), bool)
    kept[1:] = (scan[1:] != 0) | (scan[:-1] != 255)
    kept[ends[:-1]] = True
    five = scan[kept].reshape(n * UNIT // 4, 5)
    eight = np.zeros((len(five), 8), np.uint8)
    eight[:, 3:] = five
    word = eight.view(">u8")[:, 0].astype(np.uint64)
    code = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).astype(np.int64)
    return (np.cumsum(_DIFFS[code].reshape(n, UNIT), axis=1, dtype=np.int16) + 128).astype(np.uint8)


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * (len(data) + 8)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan is cut short")
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def jpeg_luma(data: bytes) -> np.ndarray:
    """Luma plane of a baseline JPEG that carries its tables; chroma is skipped over."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, parts, height, width, restart = 2, {}, {}, [], 0, 0, 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (wide + 1)
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC2, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            break
    end = data.rfind(b"\xff\xd9")
    runs, scan = [], data[at : end if end > 0 else len(data)]
    begin = 0
    for k in range(len(scan) - 1):  # restart markers part the scan
        if scan[k] == 255 and 0xD0 <= scan[k + 1] <= 0xD7:
            runs.append(scan[begin:k])
            begin = k + 2
    runs = [r.replace(b"\xff\x00", b"\xff") for r in [*runs, scan[begin:]]]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, hmax, vmax = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    h0, v0 = parts[0][1], parts[0][2]
    plane = np.zeros((down * v0 * 8, across * h0 * 8))
    bits, predicted, run = _Bits(runs[0]), dict.fromkeys((p[0] for p in parts), 0), 0
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            run += 1
            bits, predicted = _Bits(runs[run]), dict.fromkeys(predicted, 0)
        for number, (name, h, v, q) in enumerate(parts):
            dc, ac = tables[chosen[name] >> 4], tables[0x10 | chosen[name] & 15]
            for block in range(h * v):
                values = np.zeros(64, np.int64)
                predicted[name] += bits.signed(bits.symbol(dc))
                values[0] = predicted[name]
                k = 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    if symbol == 0:
                        break
                    k += symbol >> 4
                    if symbol & 15:
                        values[_ZIGZAG[k]] = bits.signed(symbol & 15) * quant[q][k]
                    k += 1
                if number == 0:
                    values[0] *= quant[q][0]
                    y, x = (unit // across * v + block // h) * 8, (unit % across * h + block % h) * 8
                    plane[y : y + 8, x : x + 8] = _COSINES @ values.reshape(8, 8) @ _COSINES.T
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:height, :width]


def shots(frames: np.ndarray, bins: int = 16, window: int = 8, factor: float = 2.5, least: float = 0.3) -> np.ndarray:
    """First frames of the shots, 0 included.

    A cut stands where the histogram differs from the last frame's by more than the mean of the
    last `window` differences plus factor times their deviation, and by `least` of all samples."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    shift, counts = 8 - bins.bit_length() + 1, np.empty((n, bins), np.int64)
    for a in range(0, n, FRAMES):
        some = frames[a : a + FRAMES].reshape(min(FRAMES, n - a), -1)
        flat = (np.arange(len(some))[:, None] * bins + (some >> shift)).reshape(-1)
        counts[a : a + FRAMES] = np.bincount(flat, minlength=len(some) * bins).reshape(-1, bins)
    diff = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2.0 * frames[0].size)
    at = np.arange(n - 1)
    low = np.maximum(at - window, 0)
    sums, squares = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    seen = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / seen
    deviation = np.sqrt(np.maximum((squares[at] - squares[low]) / seen - mean * mean, 0))
    return np.concatenate(([0], np.flatnonzero((diff > mean + factor * deviation) & (diff > least)) + 1))


def clips(media: bytes) -> list[tuple[int, float, float, int, float]]:
    """(clip, start and end in seconds, frames, mean sample) of each shot of an AVI file."""
    frames, seconds = decode(media)
    edges = [*shots(frames).tolist(), len(frames)]
    return [(i, a * seconds, b * seconds, b - a, float(frames[a:b].mean())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def payloads(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each filled with spaces to a positive multiple of UNIT, as frames (n, UNIT), and frame offsets."""
    frames = np.maximum(1, -(-np.diff(offsets) // UNIT))
    at = np.concatenate(([0], np.cumsum(frames)))
    out = np.full(at[-1] * UNIT, 32, np.uint8)
    for to, a, b in zip((at[:-1] * UNIT).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[to : to + b - a] = raw[a:b]
    return out.reshape(-1, UNIT), at


def encode(raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """An AVI file for each text."""
    frames, at = payloads(raw, offsets)
    coded = [encode_frames(frames[a : a + FRAMES]) for a in range(0, len(frames), FRAMES)]
    ends = np.cumsum([0, *(len(chunks) for chunks, _ in coded)])
    where = np.concatenate([ends[:1], *(own[1:] + end for (_, own), end in zip(coded, ends[:-1], strict=True))])
    whole = memoryview(coded[0][0] if len(coded) == 1 else np.concatenate([chunks for chunks, _ in coded]) if coded else np.zeros(0, np.uint8))
    del coded
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield container(whole[where[a] : where[b]], where[a : b + 1] - where[a])


def describe(frames: np.ndarray, seconds: float) -> str:
    """Frames, mean sample and the shots' times, in milliseconds."""
    edges = [*shots(frames).tolist(), len(frames)]
    times = ",".join(f"{round(a * seconds * 1000)}-{round(b * seconds * 1000)}" for a, b in zip(edges[:-1], edges[1:], strict=True))
    return f"frames={len(frames)};mean={int(frames.sum(dtype=np.int64)) * 1000 // max(1, frames.size)};shots={times}"


def _batches(make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                yield make(batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    return run


def _stored(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(encode(raw, offsets)), pa.binary())], names=["id", "media"])


def _digests(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    rows = []
    for media in encode(raw, offsets):
        frames, seconds = decode(media)
        payload = frames.tobytes()
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(frames, seconds)))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["id", "n_bytes", *names])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, an AVI file that holds the text, for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_batches(_stored), f"id {dict(rows.dtypes)['id']}, media binary").withColumnRenamed("id", "doc_id")


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, clip, start_s, end_s, frames and mean for every shot of every AVI file; a null file has none."""
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).filter("media is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = clips(batch.column(1)[i].as_py())
                if found:
                    columns = [pa.array(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type), *columns], names=["doc_id", "clip", "start_s", "end_s", "frames", "mean"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, clip long, start_s double, end_s double, frames long, mean double")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row.

    Each text is stored as an AVI file and read back from it. Null and empty texts give one frame
    of spaces; equal texts have equal values; null or repeated ids are passed on; an empty table
    gives no rows; other columns aren't read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_batches(_digests), schema).withColumnRenamed("id", "doc_id")
