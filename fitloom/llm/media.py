"""Media columns: signature sniffing, type correction and carving.

One Aho-Corasick pass over a value finds all magic bytes; at each hit the format's validator walks the
structure (chunk lengths, checksums, header fields) and returns where the medium ends, or nothing. The
leftmost confirmed media that don't overlap are kept: one that spans the value corrects its declared
type, the others are carved out. write_samples/read_samples store bytes as 8-bit samples losslessly.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Magic bytes, how far they lie behind the start of the medium, and the media type.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b".snd", 0, "audio/basic"),
    (b"%PDF-1.", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"P5\n", 0, "image/x-portable-graymap"),
    (b"ftyp", 4, "video/mp4"),
)
_U32 = struct.Struct("<I")


def _png(b: bytes, at: int):
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


def _gif(b: bytes, at: int):
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p):
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int):
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2
        if kind in (0x00, 0xFF) or 0xD0 <= kind <= 0xD8:
            return None
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:  # entropy-coded data runs to the next marker that isn't a restart or a stuffed byte
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
            if b[p + 1] == 0xD9:
                return p + 2
    return None


def _bmp(b: bytes, at: int):
    if at + 54 > len(b):
        return None
    size, _, data, header, width, height, planes, bits, packing, image = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    if header < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return None
    return at + size if data >= 14 + header and data + rows == size and image in (0, rows) and at + size <= len(b) else None


def _riff(form: bytes):
    def check(b: bytes, at: int):
        if at < 0 or at + 12 > len(b) or b[at : at + 4] != b"RIFF":
            return None
        end = at + 8 + _U32.unpack_from(b, at + 4)[0]
        p, found = at + 12, False
        while p + 8 <= end <= len(b):
            n = _U32.unpack_from(b, p + 4)[0]
            found |= b[p : p + 4] == form or form == b"" and b[p : p + 3] == b"VP8"
            p += 8 + n + (n & 1)
        return end if found and p == end <= len(b) else None

    return check


def _flac(b: bytes, at: int):
    p = at + 4
    if p + 4 > len(b) or b[p] & 127 or int.from_bytes(b[p + 1 : p + 4], "big") != 34:
        return None
    while p + 4 <= len(b):
        last, n = b[p] & 128, int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + n
        if last:  # frames carry no length: the stream ends with the value
            return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(b: bytes, at: int):
    p = at
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return p if at < p <= len(b) else None


def _au(b: bytes, at: int):
    if at + 24 > len(b):
        return None
    start, size, kind, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return at + start + size if start >= 24 and 1 <= kind <= 27 and rate and channels and at + start + size <= len(b) else None


def _marks(b: bytes, mark: bytes, seen: dict) -> list:
    """Places of a mark, found once per value."""
    if mark not in seen:
        seen[mark], at = [], b.find(mark)
        while at >= 0:
            seen[mark].append(at)
            at = b.find(mark, at + 1)
    return seen[mark]


_UPDATE = re.compile(rb"\s*(\d+ \d+ obj\b|xref\b)")


def _pdf(b: bytes, at: int, seen: dict):
    """To the first end mark after a startxref, or the last one if updates follow it."""
    ends, refs = _marks(b, b"%%EOF", seen), _marks(b, b"startxref", seen)
    i, r = bisect_left(ends, at), bisect_left(refs, at)
    if i == len(ends) or r == len(refs) or refs[r] > ends[i]:
        return None
    while i + 1 < len(ends) and _UPDATE.match(b, ends[i] + 5) and bisect_left(refs, ends[i + 1]) > bisect_left(refs, ends[i]):
        i += 1
    return ends[i] + 5


def _zip(b: bytes, at: int, seen: dict):
    """By its end record, which tells where the archive begins; records are read once per value."""
    if "zip" not in seen:
        seen["zip"] = {}
        for end in _marks(b, b"PK\x05\x06", seen):
            if end <= len(b) - 22:
                size, offset = struct.unpack_from("<II", b, end + 12)
                start = end - offset - size
                if start >= 0 and b[start + offset : start + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    seen["zip"].setdefault(start, end + 22 + struct.unpack_from("<H", b, end + 20)[0])
    return seen["zip"].get(at)


def _gzip(b: bytes, at: int):
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not d.eof:  # in pieces, so that a bomb stays small
            d.decompress(d.unconsumed_tail or b[p : p + 65536], 1 << 20)
            p += 0 if d.unconsumed_tail else 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) if d.eof else None


def _pgm(b: bytes, at: int):
    head = b[at : at + 64].split(None, 4)
    if len(head) < 4 or not all(x.isdigit() for x in head[1:4]) or not 0 < int(head[3]) < 256:
        return None
    p = at
    for word in head[:4]:
        p = b.index(word, p) + len(word)
    end = p + 1 + int(head[1]) * int(head[2])
    return end if end <= len(b) else None


def _mp4(b: bytes, at: int):
    p, kinds = at, set()
    while 0 <= p <= len(b) - 8:
        n, kind = struct.unpack_from(">I4s", b, p)
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"meta") or n < 8 or p + n > len(b):
            break
        kinds.add(kind)
        p += n
    return p if {b"ftyp", b"moov"} <= kinds else None


CHECKS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/wav": _riff(b"data"), "image/webp": _riff(b""),
    "audio/flac": _flac, "audio/ogg": _ogg, "audio/basic": _au, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
    "image/x-portable-graymap": _pgm, "video/mp4": _mp4,
}


MARKED = ("application/pdf", "application/zip")  # whose ends are searched for


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    a.make_automaton()
    return a


def sniff(value: bytes) -> list:
    """[(type, start, end)]: leftmost confirmed media that don't overlap."""
    out, free, seen = [], 0, {}
    hits = sorted((end - back, kind) for end, (back, kind) in automaton().iter(value.decode("latin-1")))
    for at, kind in hits:
        if at >= free:
            end = CHECKS[kind](value, at, seen) if kind in MARKED else CHECKS[kind](value, at)
            if end is not None and end > at:
                out.append((kind, at, end))
                free = end
    return out


def write_samples(data: bytes, kind: str) -> bytes:
    """Bytes, a multiple of 64, as 8-bit samples: grey pixels 64 wide, or one channel of sound."""
    rows = len(data) // 64
    if kind == "image/bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + len(data), 0, 0, 1078, 40, 64, -rows, 1, 8, 0, len(data), 2835, 2835, 256, 0)
        return head + palette + data
    if kind == "image/png":
        chunk = lambda k, b: struct.pack(">I4s", len(b), k) + b + struct.pack(">I", zlib.crc32(k + b))
        raw = np.zeros((rows, 65), np.uint8)
        raw[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, 64)
        return MAGIC[0][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(data)) + data
    raise ValueError(kind)


def read_samples(medium: bytes, kind: str) -> bytes:
    if kind == "image/bmp":
        (start,) = struct.unpack_from("<I", medium, 10)
        return medium[start:]
    if kind == "image/png":
        p, data = 8, []
        while p < len(medium):
            n, k = struct.unpack_from(">I4s", medium, p)
            if k == b"IDAT":
                data.append(medium[p + 8 : p + 8 + n])
            p += 12 + n
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, 65)
        assert not raw[:, 0].any()
        return raw[:, 1:].tobytes()
    if kind == "audio/wav":
        p = 12
        while medium[p : p + 4] != b"data":
            p += 8 + _U32.unpack_from(medium, p + 4)[0]
        return medium[p + 8 : p + 8 + _U32.unpack_from(medium, p + 4)[0]]
    raise ValueError(kind)


STORED = ("image/bmp", "image/png", "audio/wav")


_TOGETHER = 8 << 20  # bytes of values that a task holds at once; a longer value is alone


def some(column, most: int = _TOGETHER):
    """(from, to) of values with up to `most` bytes together, 256 at most."""
    sizes = np.cumsum([0, *(v or 0 for v in pa.compute.binary_length(column).to_pylist())])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + 256, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, value, declared: each text's payload as a medium of a kind chosen by its checksum.

    The payload is the UTF-8 text (null: empty) and zero bytes up to a positive multiple of 64. The
    declared type is always STORED[0], so that two thirds of the values need correction. A very long text is
    stored whole, alone in memory. Repeated rows give equal media; an empty table gives no rows. Extra columns
    are ignored.
    """

    def run(batches):
        for batch in batches:
            for lo, hi in some(batch.column("text")):
                sizes, values = [], []
                for t in batch.column("text").slice(lo, hi - lo):
                    data = (t.as_py() or "").encode()
                    sizes.append(len(data))
                    data += bytes(-len(data) % 64 if data else 64)
                    values.append(write_samples(data, STORED[zlib.crc32(data) % len(STORED)]))
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(values, pa.binary()), pa.array([STORED[0]] * len(sizes))], ["doc_id", "n_bytes", "value", "declared"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, value binary, declared string")


def media_columns(rows: DataFrame, keep: tuple, value: str = "value", declared: str = "declared", samples: bool = False) -> DataFrame:
    """The columns `keep` and: kind (corrected type), corrected, media (array of type, start, end).

    kind is the type of the first medium if it spans the value, else the declared type if nothing was
    found, else null. With samples, also `medium` (the first medium's bytes) and `payload` (its 8-bit
    samples, read from those bytes; null for kinds without). A null value is empty: no media, the
    declared type stays. A very long value is read whole, alone in memory. Repeated rows give repeated
    results; an empty table gives no rows. Other columns are ignored, also those named like results.
    """
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for lo, hi in some(batch.column(value)):
                part = batch.slice(lo, hi - lo)
                out: list = [[] for _ in range(5)]
                for v, said in zip(part.column(value), part.column(declared).to_pylist()):
                    v = v.as_py() or b""
                    found = sniff(v)
                    kind = said if not found else found[0][0] if found[0][1:] == (0, len(v)) else None
                    medium = v[found[0][1] : found[0][2]] if samples and found else None
                    payload = read_samples(medium, found[0][0]) if medium is not None and found[0][0] in STORED else None
                    row = (kind, bool(found) and kind != said, [{"kind": k, "s": a, "e": b} for k, a, b in found], medium, payload)
                    for c, x in zip(out, row):
                        c.append(x)
                span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
                cols = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), span, pa.binary(), pa.binary()))]
                names = ["kind", "corrected", "media", "medium", "payload"]
                n = 5 if samples else 3
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + cols[:n], [*keep, *names[:n]])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", kind string, corrected boolean, media array<struct<kind:string,s:long,e:long>>"
    if samples:
        schema += ", medium binary, payload binary"
    return rows.select(*dict.fromkeys([*keep, value, declared])).mapInArrow(run, schema)


def op1_media(spark, sf_dir) -> DataFrame:
    rows = media_columns(to_media(read(spark, sf_dir, "documents")), ("doc_id", "n_bytes"), samples=True)
    n = F.length("payload")
    return rows.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("medium").cast("long").alias("media_bytes"),
        F.sha2("medium", 256).alias("media_sha256"),
        F.concat_ws(";", "kind", F.concat(F.lit("corrected="), F.col("corrected").cast("string")), F.concat(F.lit("media="), F.size("media").cast("string")), F.concat(F.lit("64x"), (n / 64).cast("long").cast("string"))).alias("feature"),
    )
