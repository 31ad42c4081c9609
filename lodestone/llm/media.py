"""Media columns: baseline JPEG written and read in numpy.

Writing: a payload's bytes become the 64 quantized coefficients of 8 x 8 blocks of
a grey picture. A byte b becomes the coefficient b (from 128 on) or b - 255, all of
which have magnitude 8 bits and b itself as their extra bits, so one-bit Huffman
codes and a restart after each block make every block 72 bytes before stuffing.

Reading: any baseline JPEG of one or three components. Markers are parsed, entropy
data is cut at restart markers, and all segments of all pictures with the same
tables are Huffman-decoded in lockstep, a coefficient of each at a time. Thumbnails
are the dequantized DC values of the luminance blocks.

A null or empty text is an empty payload padded; equal payloads, so repeated rows, give
equal files; very long texts make one picture, wider beyond MOST_HIGH blocks; other
columns are left out; an empty table has no rows; a file that is no baseline JPEG
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, UNIT, PAD = 64, 576, 255
#: Pictures up to this many blocks high; wider beyond.
MOST_HIGH = 8000
STEP_BYTES = 8 << 20


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _shape(n_blocks: int) -> tuple[int, int]:
    wide = 3 * -(-n_blocks // (3 * MOST_HIGH))
    return wide, -(-n_blocks // wide)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _head(size: int, wide: int, high: int) -> bytes:
    one_code = bytes([1] + [0] * 15)
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % size),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + one_code + b"\x08" + b"\x10" + one_code + b"\x08"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def write_many(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (a positive multiple of 64 bytes)."""
    if not payloads:
        return []
    shapes = [_shape(len(p) // BLOCK) for p in payloads]
    sizes = np.array([w * h for w, h in shapes], np.int64)
    filled = b"".join(p + bytes([PAD]) * (int(n) * BLOCK - len(p)) for p, n in zip(payloads, sizes))
    data = np.frombuffer(filled, np.uint8).reshape(-1, BLOCK)
    n = len(data)
    bits = np.zeros((n, BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data, axis=1).reshape(n, BLOCK, 8)
    rows = np.empty((n, 74), np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(n, -1), axis=1)
    ends = np.cumsum(sizes)
    rows[:, 72] = 255
    rows[:, 73] = 0xD0 + (np.arange(n) - np.repeat(ends - sizes, sizes)) % 8
    rows[ends - 1, 73] = 0xD9
    flat = rows.reshape(-1)
    stuffed = flat == 255
    stuffed.reshape(n, 74)[:, 72] = False
    size = 1 + stuffed
    to = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[to] = flat
    stops = np.append(to, len(out))[ends * 74]
    made, start = out.tobytes(), 0
    files = []
    for p, (w, h), stop in zip(payloads, shapes, stops.tolist()):
        files.append(_head(len(p), w, h) + made[start:stop])
        start = stop
    return files


@dataclass
class Picture:
    width: int
    height: int
    parts: list[tuple[int, int, int, int]]  # id, horizontal, vertical, quantization table
    tables: dict[int, bytes] = field(default_factory=dict)  # Huffman, by class and id
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC and AC table
    restart: int = 0
    comment: bytes = b""
    data: tuple[int, int] = (0, 0)
    coefficients: list[np.ndarray] = field(default_factory=list)

    def units(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def layout(self) -> list[tuple[int, int, int]]:
        """The blocks of a unit: component's place, DC and AC table."""
        single = len(self.parts) == 1
        return [s for s in self.scan for _ in range(1 if single else self.parts[s[0]][1] * self.parts[s[0]][2])]


def parse(raw: bytes) -> Picture:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, restart, comment, pic = 2, {}, {}, 0, b"", None
    while at + 4 <= len(raw):
        if raw[at] != 255:
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 255:
            at += 1
            continue
        body = raw[at + 4 : at + 2 + int.from_bytes(raw[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            depth, high, wide, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3):
                raise ValueError("only 8 bits and one or three components are baseline here")
            pic = Picture(wide, high, [(c, hv >> 4, hv & 15, q) for c, hv, q in zip(body[6::3], body[7::3], body[8::3])])
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if pic is None or body[0] != len(pic.parts):
                raise ValueError("only one interleaved scan is supported")
            place = {p[0]: i for i, p in enumerate(pic.parts)}
            pic.scan = [(place[c], t >> 4, 16 | t & 15) for c, t in zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2])]
            pic.quant, pic.tables, pic.restart, pic.comment, pic.data = quant, tables, restart, comment, (at, len(raw))
            return pic
    raise ValueError("no scan")


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: the symbol of the code they begin with, shifted by 8, and its length."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = table[at] << 8 | length
            at += 1
            code += 1
        code <<= 1
    return out


def _scans(files: list[bytes], pics: list[Picture]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Entropy data without stuffing, end to end; where each segment begins; segments of each picture."""
    parts = [f[slice(*p.data)] for f, p in zip(files, pics)]
    flat = np.frombuffer(b"".join(parts) + b"\0\0", np.uint8)
    sizes = np.array([len(x) for x in parts], np.int64)
    after = flat[1:]
    mark = np.flatnonzero(flat[:-1] == 255)
    second = after[mark]
    keep = np.ones(len(flat), bool)
    keep[mark[second == 0] + 1] = False
    true = mark[(second != 0) & (second != 255)]
    keep[true] = False
    keep[true + 1] = False
    place = np.cumsum(keep) - keep
    restart = true[(after[true] & 0xF8) == 0xD0]
    starts = np.cumsum(sizes) - sizes
    begins = np.sort(np.concatenate([starts, restart + 2]))
    counts = np.diff(np.append(np.searchsorted(begins, starts), len(begins))).tolist()
    return flat[keep], place[begins], counts


def _lockstep(files: list[bytes], pics: list[Picture]) -> None:
    """Decodes pictures with equal tables, layout and restart interval."""
    first = pics[0]
    layout = first.layout()
    luts = {k: _lookup(t) for k, t in first.tables.items()}
    data, begins, counts = _scans(files, pics)
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
    units = [int(np.prod(p.units())) for p in pics]
    most = [min(first.restart, u) if first.restart else u for u in units]
    need = np.concatenate([np.minimum(first.restart or u, u - np.arange(c) * (first.restart or u)) for u, c in zip(units, counts)])
    if any(c != -(-u // (m or 1)) for u, c, m in zip(units, counts, most)):
        raise ValueError("restart markers are missing")
    pos = begins.astype(np.int64) * 8
    limit = len(word) - 1
    per = [sum(1 for x in layout if x[0] == c) for c in range(len(first.parts))]
    unit_at = np.cumsum(need) - need
    out = [np.zeros((int(need.sum()), n, 64), np.int16) for n in per]
    dc = np.zeros((len(first.parts), len(pos)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        return word[np.minimum(p >> 3, limit)] >> (16 - (p & 7)).astype(np.uint32) & np.uint32(0xFFFF)

    def extra(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (peek(p) >> (16 - n).astype(np.uint32)).astype(np.int64)
        return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)

    for unit in range(int(need.max()) if len(need) else 0):
        live = np.flatnonzero(need > unit)
        seen = [0] * len(per)
        for c, dc_table, ac_table in layout:
            p = pos[live]
            code = luts[dc_table][peek(p)]
            if (code == 0).any():
                raise ValueError("a code that is in no table")
            n = (code >> 8).astype(np.int64)
            p = p + (code & 255)
            dc[c, live] += extra(p, n)
            p = p + n
            block = out[c].reshape(-1, 64)
            row = (unit_at[live] + unit) * per[c] + seen[c]
            seen[c] += 1
            block[row, 0] = dc[c, live]
            k = np.ones(len(live), np.int64)
            todo = np.arange(len(live))
            lut = luts[ac_table]
            whole = True
            while len(todo):
                q = p if whole else p[todo]
                code = lut[peek(q)]
                if (code == 0).any():
                    raise ValueError("a code that is in no table")
                symbol = (code >> 8).astype(np.int64)
                n, run = symbol & 15, symbol >> 4
                q = q + (code & 255)
                kk = (k if whole else k[todo]) + run
                value = extra(q, n)
                if kk.max() > 63 and (kk[n > 0] > 63).any():
                    raise ValueError("a block has too many coefficients")
                if n.all():
                    block[row if whole else row[todo], kk] = value
                else:
                    put = np.flatnonzero(n)
                    block[(row if whole else row[todo])[put], kk[put]] = value[put]
                done = ((n == 0) & (run < 15)) | (kk >= 63)
                if whole:
                    p, k = q + n, kk + 1
                else:
                    p[todo], k[todo] = q + n, kk + 1
                if done.any():
                    todo = todo[~done]
                    whole = False
            pos[live] = p
    at = 0
    for p, u in zip(pics, units):
        p.coefficients = [o[at : at + u] for o in out]
        at += u


def read_many(files: list[bytes]) -> list[Picture]:
    """Pictures with their coefficients: for each component (units, blocks in a unit, 64), zigzag order."""
    pics = [parse(f) for f in files]
    groups = defaultdict(list)
    for i, p in enumerate(pics):
        groups[(tuple(sorted(p.tables.items())), tuple(p.scan), tuple(x[1:3] for x in p.parts), p.restart)].append(i)
    for own in groups.values():
        held, size = [], 0
        for i in own:
            held.append(i)
            size += len(files[i])
            if size >= STEP_BYTES:
                _lockstep([files[j] for j in held], [pics[j] for j in held])
                held, size = [], 0
        if held:
            _lockstep([files[j] for j in held], [pics[j] for j in held])
    return pics


def thumbnail(p: Picture) -> np.ndarray:
    """One grey value for each luminance block, from its DC coefficient."""
    wide, high = p.units()
    h, v = (1, 1) if len(p.parts) == 1 else p.parts[0][1:3]
    dc = p.coefficients[0][:, :, 0].astype(np.int32) * int(p.quant[p.parts[0][3]][0])
    grey = np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return grey.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)


def feature(p: Picture) -> str:
    """Dimensions, thumbnail's dimensions, its average hash over 8 x 8 samples, and a digest of it."""
    t = thumbnail(p)
    small = t[np.arange(8) * t.shape[0] // 8][:, np.arange(8) * t.shape[1] // 8]
    average = np.packbits(small > small.mean()).tobytes().hex()
    return f"{p.width}x{p.height} {t.shape[1]}x{t.shape[0]} {average} {hashlib.blake2b(t.tobytes(), digest_size=8).hexdigest()}"


def payload(p: Picture) -> bytes:
    """What write_many() stored in a picture of its own."""
    if not p.comment.startswith(b"payload="):
        raise ValueError("the picture holds no payload")
    c = p.coefficients[0].reshape(-1)[: int(p.comment[8:])]
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column("raw").to_pylist()]
            held, size, made = [], 0, []
            for x in raw:
                held.append(padded(x))
                size += len(x)
                if size >= STEP_BYTES:
                    made += write_many(held)
                    held, size = [], 0
            made += write_many(held)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", F.encode(F.col(text), "utf-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def load(df: DataFrame) -> DataFrame:
    """Adds payload and feature, decoded from the column ``media`` (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            pics = iter(read_many([f for f in files if f is not None]))
            both = [(None, None) if f is None else (payload(p := next(pics)), feature(p)) for f in files]
            cols = [pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "payload", "feature"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    x = load(store(docs.select("doc_id", "text")))
    return x.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )
