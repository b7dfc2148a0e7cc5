"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Each segment is read as a word of the
binary (23,12) Golay code: its codewords within distance 3 (one) and within 4 (one or six) are its near
and wide indices. Of 4 differing bits, the two best segments hold at most 2 (pigeonhole), and

* one of them is equal and the other differs in at most 2 bits: two words that near share a wide index,
  so keys (equal segment, wide index) meet, for each ordered pair of segments;
* or each differs in exactly 1 bit: the near index of a word is a wide index of any word one bit away,
  so a key of roles A (near, wide) and B (wide, near) meets on (near of one, near of the other).

Keys are joined by a shuffle; every key's members are verified by their bits, and only a spanning
forest of the verified links leaves a key's group, so a large group of copies yields as many links as
members. Components are found by star contraction on written tables.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, given_back, partitions, read, set_aside, stage, unstage

#: The Golay code's generator polynomial, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SEED = 42
MAX_BITS = 4
_STEP = 1 << 16


@lru_cache(maxsize=1)
def golay() -> tuple:
    """syndrome of a word's high 12 bits and low 11 bits; error patterns of weight <= 4 by syndrome (first: the leader)."""
    high = np.zeros(1 << 12, np.int32)
    for m in range(1 << 12):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= GENERATOR << (i - 11)
        high[m] = r

    def syndrome(x: int) -> int:
        return int(high[x >> 11]) ^ (x & 2047)

    found: list = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[syndrome(e)].append(e)
    errors = np.full((1 << 11, max(map(len, found))), -1, np.int32)
    for s, es in enumerate(found):
        errors[s, : len(es)] = es
    return high, errors


def indices(words: np.ndarray) -> tuple:
    """(near, wide): the codeword index within 3, and all within 4 (-1 where there is none)."""
    high, errors = golay()
    words = words.astype(np.int32)
    e = errors[high[words >> 11] ^ (words & 2047)]
    wide = np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)
    return wide[:, 0], wide


def keys(fps: np.ndarray) -> tuple:
    """(row, key, role) of fingerprints: role 0 meets 0, role 1 meets 2."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near, wide = zip(*(indices(s) for s in seg))
    near = [x.astype(np.int64) for x in near]
    wide = [x.astype(np.int64) for x in wide]
    rows = np.arange(len(fps))
    out = []

    def add(family: int, left: np.ndarray, right: np.ndarray, role: int) -> None:
        key = (left << 12) | right
        row = np.broadcast_to(rows[:, None], key.shape)
        ok = right >= 0
        ok = np.broadcast_to(ok, key.shape) & np.broadcast_to(left >= 0, key.shape)
        out.append((row[ok], key[ok] | (np.int64(family) << np.int64(40)), np.full(int(ok.sum()), role, np.int8)))

    family = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                add(family, seg[a][:, None], wide[b], 0)
                family += 1
    for a, b in combinations(range(3), 2):
        add(family, near[a][:, None], wide[b], 1)
        add(family, wide[a], np.broadcast_to(near[b][:, None], wide[a].shape), 2)
        family += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the lower-cased words' shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for lo in range(0, n, _STEP):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[lo : lo + _STEP], ends[lo : lo + _STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple = ()) -> DataFrame:
    """doc_id, fp long (the 64 bits as a signed number) and the columns `keep` for every row."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *(batch.column(c) for c in keep)], ["doc_id", "fp", *keep])

    schema = ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *(f"`{c}` {kinds[c]}" for c in keep)])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> list:
    """Spanning forest, as index pairs, of pairs (left role, right role) at most `most` bits apart."""
    n = len(fps)
    open_ = np.arange(n)
    out = []
    while len(open_) > 1:
        queue = [int(open_[0])]
        open_ = open_[1:]
        while queue and len(open_):
            i = queue.pop()
            near = np.bitwise_count(fps[open_] ^ fps[i]) <= most
            near &= (right[open_] & left[i]) | (left[open_] & right[i])
            hit = open_[near]
            if len(hit):
                out.extend((i, int(j)) for j in hit)
                queue.extend(hit.tolist())
                open_ = open_[~near]
    return out


def _links_of_runs(key, fp, node, role, most: int, src: list, dst: list) -> None:
    """Links of whole key groups; key is sorted."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], cut])
    stop = np.concatenate([cut, [len(key)]])
    many = stop - start > 1
    # a key of roles 1 and 2 matters only if both occur
    has1 = np.add.reduceat((role == 1).astype(np.int32), start) > 0
    has2 = np.add.reduceat((role == 2).astype(np.int32), start) > 0
    zero = role[start] == 0
    start, stop = start[many & (zero | (has1 & has2))], stop[many & (zero | (has1 & has2))]
    # pairs of two rows: all at once
    two = stop - start == 2
    a, b = start[two], start[two] + 1
    ok = (fp[a] != fp[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= most)
    src.append(node[a[ok]])
    dst.append(node[b[ok]])
    for lo, hi in zip(start[~two].tolist(), stop[~two].tolist()):
        f, nd, ro = fp[lo:hi], node[lo:hi], role[lo:hi]
        u, first, inverse = np.unique(f, return_index=True, return_inverse=True)
        if len(u) < 2:
            continue
        left, right = np.zeros(len(u), bool), np.zeros(len(u), bool)
        left[inverse[ro != 2]] = True
        right[inverse[ro != 1]] = True
        pairs = forest(u, left, right, most)
        if pairs:
            p = np.array(pairs)
            src.append(nd[first[p[:, 0]]])
            dst.append(nd[first[p[:, 1]]])


def links(nodes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """src, dst: verified links that connect the same nodes as all links do. nodes: node, fp (distinct)."""

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            node = batch.column("node").to_numpy()
            for lo in range(0, len(fp), 4096):
                row, key, role = keys(fp[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[lo : lo + 4096][row].view(np.int64)), pa.array(node[lo : lo + 4096][row]), pa.array(role)],
                    ["key", "fp", "node", "role"],
                )

    def meet(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "fp", "node", "role")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            held = [c[last:] for c in cols]
            if last:
                yield from found([c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield from found(held)

    def found(cols):
        src, dst = [], []
        _links_of_runs(cols[0], cols[1].view(np.uint64), cols[2], cols[3], most, src, dst)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    spark = nodes.sparkSession
    dealt = (
        nodes.mapInArrow(spread, "key long, fp long, node long, role byte")
        .repartition(partitions(spark), "key")
        .sortWithinPartitions("key")
    )
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return dealt.mapInArrow(meet, "src long, dst long").select(a.alias("src"), b.alias("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for nodes with links: alternating large-star and small-star, which
    ends after about log(n)^2 rounds at most, however long the chains."""
    edges = stage(edges, "cc")
    while True:
        # large star: every larger neighbour of u goes to u's least neighbour (u included)
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("m").alias("src"), F.col("v").alias("dst")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        down = large.select(F.col("dst").alias("u"), F.col("src").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").filter("v != m").select(F.col("m").alias("src"), F.col("v").alias("dst"))
            .union(low.select(F.col("m").alias("src"), F.col("u").alias("dst")))
            .distinct()
        )
        new = stage(small, "cc")
        # star-shaped: no destination is a source, and each has one source; such a graph is its own result
        n = new.agg(F.count("*"), F.count_distinct("dst")).first()
        chained = new.select(F.col("src").alias("x")).distinct().join(new.select(F.col("dst").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        unstage(edges)
        edges = new
        if not chained and n[0] == n[1]:
            break
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("component")).union(edges.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = MAX_BITS, keep: tuple = ()) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable by links), component (the least
    fingerprint of the component, a number) and the columns `keep` for every row.

    A null or wordless text has fingerprint zero and is linked like any other; a very long text is hashed
    whole. Rows with a null doc_id have their own fingerprint and take part only as members (their
    component_id is the least id there is, null if there is none). Repeated rows get equal results. An
    empty table gives no rows. Extra columns are ignored. Texts with equal fingerprints are one node, so a
    group of copies makes no links.
    """
    fps = stage(fingerprints(docs, shingle, keep), "simhash-fp")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")).withColumn("node", F.col("fp")), "simhash-nodes")
    edges = links(nodes.select("node", "fp"), most)
    comp = stage(components(edges), "simhash-cc")
    ids = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    known = ids.join(least, "component").select("fp", "component", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", *keep)


def representatives(docs: DataFrame, shingle: int = 4, most: int = MAX_BITS) -> DataFrame:
    """Of each component one row of docs: that with the smallest doc_id; of those with one id, or without any, the first.

    Decided by row, so rows that share an id but not a component stay. Wordless texts are one component.
    Columns may have any names.
    """
    rows, view = set_aside(docs, "simhash-rows", ("doc_id", "text"))
    found = near_duplicates(view, shingle, most, (ROW,))
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("c")).select(F.col(f"c.{ROW}").alias(ROW))
    return given_back(rows.join(chosen, ROW, "left_semi"), docs.columns)


def op3_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("component")
