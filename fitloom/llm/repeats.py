"""Repeated byte windows across documents by a depth-limited most-significant-digit radix sort.

Two windows of `depth` bytes are equal exactly if they fall into one group after digit passes through
depth bytes. Ordering every suffix would move each byte many times, so windows are sorted through
their anchors: the first digit of a window is its least k-byte string by hash (leftmost on ties), which
equal windows share at the same place. Consecutive windows with one anchor form a context, and passes
go on only with groups of two or more:

1. digit one: the anchor's k bytes. Contexts alone with it hold no repeated window.
2. digit two: the whole context. If a group has but one context text, all its windows are repeated.
3. last digit: the single windows of the contexts that are left, ordered in groups of a bounded size and
   compared byte by byte; groups of more than HEAVY contexts are ordered by a shuffle of their windows
   instead, so no group has to fit a task.

Digits are 64-bit hashes. Contexts taken for equal agree in three (192 bits), windows of the large groups
in two (128 bits), all other windows in their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, partitions, read, stage, unstage

DEPTH = 200
HEAVY = 50_000
_SLICE = 1 << 20
_POS = 26
_U = np.uint64


def _table(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers by splitmix64."""
    x = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) | _U(1)


_BYTES, _LEFT, _RIGHT = _table(1, 256), _table(2, 40), _table(3, 40)


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    h = a * _LEFT[level]
    h += b * _RIGHT[level]
    h ^= h >> _U(29)
    return h


def digits(data: np.ndarray, lengths: tuple) -> dict:
    """Hashes of the strings of each length that start at every position (as many as fit)."""
    out, h, n, level = {}, _BYTES[data], 1, 0
    powers = {1: h}
    while 2 * n <= max(lengths) and len(h) > n:
        h = _join(h[:-n], h[n:], level)
        n, level = 2 * n, level + 1
        powers[n] = h
    for length in lengths:
        got, at = None, 0
        for i in reversed(range(length.bit_length())):
            n = 1 << i
            if length & n:
                if len(data) < length or n not in powers:
                    got = np.zeros(0, np.uint64)
                    break
                part = powers[n][at:]
                got = part if got is None else _join(got[: len(part)], part, 20 + i)
                at += n
        out[length] = got
    return out


def anchor_length(depth: int) -> int:
    """A power of two, at most 32 and at most a quarter of the depth."""
    k = 1
    while 2 * k <= min(32, depth // 4):
        k *= 2
    return k


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    rest = width - n
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def contexts(data: np.ndarray, left: np.ndarray, depth: int) -> tuple:
    """(khash, head, tail, p0, p1) of every run of windows with one anchor; head and tail are the digits of its
    first and last window, which cover it. left: bytes from each position to its text's end."""
    k = anchor_length(depth)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < depth:
        return none
    h = digits(data, (k, depth))
    kh, wh = h[k], h[depth]
    mixed = kh * _U(0xD6E8FEB86659FD93)
    low = least((mixed >> _U(_POS) << _U(_POS)) | np.arange(len(kh), dtype=np.uint64), depth - k + 1)
    anchor = (low & _U((1 << _POS) - 1)).astype(np.int64)
    n = len(data) - depth + 1
    ok = left[:n] >= depth
    p = np.flatnonzero(ok)
    if not len(p):
        return none
    a, d = anchor[p], p + left[p]
    new = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1) | (np.diff(d) != 0)) + 1
    start = np.concatenate([[0], new])
    stop = np.concatenate([new, [len(p)]]) - 1
    p0, p1 = p[start], p[stop]
    return kh[a[start]], wh[p0] ^ ((p1 - p0).astype(np.uint64) * _LEFT[38]), wh[p1], p0, p1


def utf8(column) -> tuple:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, depth: int):
    """(first text, last text + 1, from, to): texts together up to _SLICE bytes; a longer text in overlapping parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
        else:
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            for at in range(lo, max(lo + 1, hi - depth + 1), _SLICE):
                yield i, i + 1, at, min(hi, at + _SLICE + depth - 1)
            i += 1


def anchored(docs: DataFrame, depth: int) -> DataFrame:
    """khash, head, tail, row, p0, span (bytes of the context) of every context. docs: ROW, text."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            row = batch.column(ROW).to_numpy()
            for i, j, lo, hi in slices(offsets, depth):
                ends = np.repeat(offsets[i + 1 : j + 1], np.diff(np.clip(offsets[i : j + 1], lo, hi)))
                left = np.minimum(ends, hi) - np.arange(lo, hi)
                kh, head, tail, p0, p1 = contexts(data[lo:hi], left, depth)
                if len(kh):
                    doc = np.searchsorted(offsets[i : j + 1], p0 + lo, "right") - 1 + i
                    cols = (kh.view(np.int64), head.view(np.int64), tail.view(np.int64), row[doc], p0 + lo - offsets[doc], (p1 - p0 + depth).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["khash", "head", "tail", "row", "p0", "span"])

    return docs.select(ROW, "text").mapInArrow(run, "khash long, head long, tail long, row long, p0 long, span int")


def window_digits(data: np.ndarray, sizes: np.ndarray, khash: np.ndarray, depth: int) -> tuple:
    """(context, place in it, place in data, digit) of every window of contexts that lie one after another in data."""
    ends = np.cumsum(sizes)
    wh = digits(data, (depth,))[depth]
    left = np.repeat(ends, sizes) - np.arange(len(data))
    p = np.flatnonzero(left >= depth)
    c = np.repeat(np.arange(len(sizes)), sizes)[p]
    return c, p - (ends - sizes)[c], p, wh[p] ^ (khash.view(np.uint64)[c] * _U(0xFF51AFD7ED558CCD))


def equal_windows(data: np.ndarray, p: np.ndarray, digit: np.ndarray, depth: int) -> np.ndarray:
    """Which windows have an equal one, of windows at rising places p: sorted by digit, then compared by their bytes.

    Every window is compared with the first of its digit: from end to end, or, where the window before it was
    compared with the place before that one, in the byte that is new.
    """
    if not len(p):
        return np.zeros(0, bool)
    rank = np.argsort(digit)
    by = digit[rank]
    start = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    size = np.diff(np.append(start, len(by)))
    first = np.repeat(np.minimum.reduceat(p[rank], start), size)
    partner = np.empty(len(p), np.int64)
    partner[rank] = first
    twice = np.zeros(len(p), bool)
    twice[rank] = np.repeat(size > 1, size)
    i = np.flatnonzero(twice & (partner != p))
    if not len(i):
        return twice
    a, b = p[i], partner[i]
    on = np.concatenate([[False], (np.diff(i) == 1) & (np.diff(a) == 1) & (np.diff(b) == 1)])
    same = data[a + depth - 1] == data[b + depth - 1]
    heads, each = np.flatnonzero(~on), np.arange(depth)
    for lo in range(0, len(heads), 4096):
        h = heads[lo : lo + 4096]
        same[h] = (data[a[h][:, None] + each] == data[b[h][:, None] + each]).all(1)
    if not same.all():  # digits of different strings agree: their windows are told apart by their bytes
        doubt = np.flatnonzero(np.isin(digit, digit[i[~same]]))
        seen: dict = {}
        for j in doubt.tolist():
            seen.setdefault(data[p[j] : p[j] + depth].tobytes(), []).append(j)
        twice[doubt] = False
        for group in seen.values():
            twice[group] = len(group) > 1
    return twice


def runs(c: np.ndarray, at: np.ndarray, depth: int) -> tuple:
    """(context, start, end) of maximal runs of repeated windows."""
    if not len(c):
        return c, at, at
    new = np.flatnonzero((np.diff(c) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(c)]]) - 1
    return c[first], at[first], at[last] + depth


def repeated_spans(docs: DataFrame, depth: int = DEPTH, heavy: int = HEAVY) -> DataFrame:
    """row, s, e: byte spans whose every window of depth bytes also starts elsewhere. docs: a written table of ROW, text."""
    found = stage(anchored(docs, depth), "repeats-anchors")
    groups = found.groupBy("khash").agg(
        F.count("*").alias("n"), ((F.min("head") != F.max("head")) | (F.min("tail") != F.max("tail"))).alias("mixed")
    ).filter("n > 1")
    groups = stage(groups, "repeats-groups")  # written, so that the join can split a very common anchor among tasks
    hits = stage(found.join(groups, "khash").select("khash", "row", "p0", "span", "n", "mixed"), "repeats-hits")
    unstage(found)
    unstage(groups)
    whole = hits.filter(~F.col("mixed")).select("row", F.col("p0").alias("s"), (F.col("p0") + F.col("span")).alias("e"))
    lists = hits.filter("mixed").groupBy("row").agg(F.collect_list(F.struct("khash", "p0", "span", (F.col("n") > heavy).alias("heavy"))).alias("cs"))

    def cut(batches):
        for batch in batches:
            for row, text, cs in zip(*(batch.column(c) for c in ("row", "text", "cs"))):
                data = (text.as_py() or "").encode()
                kh, p0, span, hv = (x.to_numpy(zero_copy_only=False) for x in cs.values.flatten())
                for lo in range(0, len(kh), 4096):  # a very long text's contexts go out a part at a time
                    part = slice(lo, lo + 4096)
                    bodies = pa.array([data[a : a + n] for a, n in zip(p0[part].tolist(), span[part].tolist())], pa.binary())
                    cols = [pa.array(kh[part]), pa.array(np.full(len(bodies), row.as_py())), pa.array(p0[part]), bodies, pa.array(hv[part])]
                    yield pa.RecordBatch.from_arrays(cols, ["khash", "row", "p0", "context", "heavy"])

    texts = docs.select(F.col(ROW).alias("row"), "text")
    left = stage(texts.join(lists, "row").mapInArrow(cut, "khash long, row long, p0 long, context binary, heavy boolean"), "repeats-contexts")

    def order(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            kh = held.column("khash").to_numpy()
            last = int(np.searchsorted(kh, kh[-1])) if len(kh) else 0
            if last >= 4096:
                yield from ordered(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from ordered(held)

    def ordered(t):
        kh, row, p0 = (t.column(c).to_numpy() for c in ("khash", "row", "p0"))
        lo = 0
        while lo < len(kh):  # whole groups, about 4096 contexts at a time
            hi = min(len(kh), lo + 4096)
            hi = int(np.searchsorted(kh, kh[hi - 1], "right"))
            data, offsets = utf8(t.column("context").slice(lo, hi - lo).combine_chunks().cast(pa.binary()))
            data = data[offsets[0] : offsets[-1]]
            c, at, p, digit = window_digits(data, np.diff(offsets), kh[lo:hi], depth)
            twice = equal_windows(data, p, digit, depth)
            c, s, e = runs(c[twice], at[twice], depth)
            c += lo
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(row[c]), pa.array(p0[c] + s), pa.array(p0[c] + e)], ["row", "s", "e"])
            lo = hi

    def windows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                data, offsets = utf8(part.column("context"))
                data = data[offsets[0] : offsets[-1]]
                kh, row, p0 = (part.column(x).to_numpy() for x in ("khash", "row", "p0"))
                c, at, _, digit = window_digits(data, np.diff(offsets), kh, depth)
                yield pa.RecordBatch.from_arrays([pa.array(kh[c]), pa.array(digit.view(np.int64)), pa.array(row[c]), pa.array(p0[c] + at)], ["khash", "digit", "row", "s"])

    light = (
        left.filter("not heavy")
        .repartition(partitions(docs.sparkSession), "khash")
        .sortWithinPartitions("khash")
        .mapInArrow(order, "row long, s long, e long")
    )
    each = left.filter("heavy").mapInArrow(windows, "khash long, digit long, row long, s long")
    # written like the groups: the join can split a very common window among tasks
    twice = stage(each.groupBy("khash", "digit").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeats-windows")
    big = each.join(twice, ["khash", "digit"]).select("row", "s", (F.col("s") + depth).alias("e"))
    spans = stage(whole.unionByName(light).unionByName(big), "repeats-spans")
    for used in (hits, left, twice):
        unstage(used)
    return spans


def remove_repeats(docs: DataFrame, depth: int = DEPTH, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (array of removed [s, e)) for every row.

    Rows are told apart by a number of their own, so ids may repeat or be null, of any type. A null text is
    empty; texts shorter than depth lose nothing; a repeated row repeats all its windows. A very long text
    is looked at in overlapping slices, and its spans are those of the whole. An empty table gives no rows.
    Extra columns are ignored, whatever their names.
    """
    keyed = numbered(docs.select("doc_id", "text"), "repeats-rows")
    spans = repeated_spans(keyed, depth, heavy)
    per = spans.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cut"))

    def strip(batches):
        for batch in batches:
            texts, cuts = batch.column("text"), batch.column("cut")
            sizes, kept, spans = [], [], []
            for text, cut in zip(texts, cuts):
                data = (text.as_py() or "").encode()
                merged: list = []
                if cut.is_valid:
                    s, e = (x.to_numpy() for x in cut.values.flatten())
                    top = np.maximum.accumulate(e)
                    new = np.flatnonzero(s[1:] > top[:-1]) + 1
                    merged = list(zip(s[np.concatenate([[0], new])].tolist(), top[np.concatenate([new, [len(s)]]) - 1].tolist()))
                at, parts = 0, []
                for s, e in merged:
                    parts.append(data[at:s])
                    at = e
                parts.append(data[at:])
                sizes.append(len(data))
                kept.append(b"".join(parts))
                spans.append([{"s": s, "e": e} for s, e in merged])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])

    return keyed.join(per, ROW, "left").select("doc_id", "text", "cut").mapInArrow(
        strip, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, kept binary, spans array<struct<s:long,e:long>>"
    )


def op4_repeats(spark, sf_dir) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
