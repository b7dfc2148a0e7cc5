"""Gated recurrent language model with a class-factored softmax.

The commonest WORDS words (the end mark among them) have outputs of their own: a softmax over classes,
then over the words of the class. All other words share TAILS tail classes told by their looks (length,
accents, closing mark); within one, words follow their smoothed training counts, with one more word of
count 0 for all unknown ones, so that the probabilities of all words sum to 1.

Counts are taken from every training document by one shuffle on word keys. The network is trained on
every training document in ROUNDS slices: in each, tasks run truncated backpropagation over their
documents from the same parameters, which are then averaged by tokens (two levels of sums, no driver).
Scoring carries the state across windows, from a document's first word to its end. Words too rare for
the broadcast table (COUNTED words, a fixed bound) get their counts by a join.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import read, stage

WORDS = 4096
CLASS_SIZE = 64
TAILS = 16
COUNTED = 1 << 17
HIDDEN = 16
LANES, WINDOW = 384, 32
SEGMENT = 512  # training restarts the state after so many tokens of a document
RATE = 0.08
ROUNDS = 3
ALPHA = 0.1
END = b"\n"  # no word holds white space
_CHUNK_TOKENS = 1 << 22
_TOP = 1 << 63


_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,!?;:|")] = True


def word_keys(words: list) -> np.ndarray:
    """For every word a negative number: 4 bits for the tail class, 59 of the word's XXH64."""
    n = len(words)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.int64, n)
    tail = (size > 4).astype(np.uint64) + (size > 7) + (size > 11)
    tail += np.uint64(8) * _CLOSING[np.fromiter((w[-1] for w in words), np.uint8, n)]
    tail += np.uint64(4) * ~np.fromiter(map(bytes.isascii, words), bool, n)
    tail[np.fromiter((w == END for w in words), bool, n)] = 0
    return (np.uint64(_TOP) | tail << np.uint64(59) | h >> np.uint64(5)).view(np.int64)


def word_key(word: bytes) -> int:
    return int(word_keys([word])[0])


def tail_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(59)).astype(np.int64) & (TAILS - 1)


_NEW = 1 << 62  # numbers from here on stand for words whose own number is still to be found


class Known(dict):
    """Numbers of words: the rank below COUNTED, else the key. Remembers a bounded number of words."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.order, self.new = np.argsort(keys), []
        self.sorted = keys[self.order]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = _NEW + len(self.new)
        self.new.append(word)
        return found

    def of(self, texts: list) -> list:
        """The numbers of each text's words and its end; new words are hashed and looked up together."""
        if len(self) > 400_000:
            self.clear()
        split = [(t or "").encode().lower().split() for t in texts]
        for ws in split:
            ws.append(END)
        ends = np.cumsum([len(ws) for ws in split])
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.new:
            k = word_keys(self.new)
            if len(self.sorted):
                at = np.minimum(np.searchsorted(self.sorted, k), len(self.sorted) - 1)
                k = np.where(self.sorted[at] == k, self.order[at], k)
            self.update(zip(self.new, k.tolist()))
            self.new = []
            late = codes >= _NEW
            codes[late] = k[codes[late] - _NEW]
        return np.split(codes, ends[:-1])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """key, n: occurrences of every word and of the end mark in docs."""

    def run(batches):
        from collections import Counter

        held: Counter = Counter()
        for batch in batches:
            text = batch.column("text")
            for lo in range(0, len(text), 256):
                for t in text.slice(lo, 256).to_pylist():
                    held.update((t or "").encode().lower().split())
                    held[END] += 1
                if len(held) > 400_000:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(word_keys(list(held))), pa.array(list(held.values()), pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Layout:
    """What tasks need besides parameters: ranks, counts, classes. Size bounded by COUNTED."""

    def __init__(self, keys: list, counts: list, words: int, total: int, distinct: int, tails: dict):
        end = word_key(END)
        self.keys = np.array(keys, np.int64)
        self.counts = np.array(counts, np.int64)
        self.words = min(words, len(keys))
        self.end = keys.index(end) if end in keys else -1
        self.total, self.distinct = total, distinct
        self.tail_n = np.array([tails.get(k, (0, 0))[0] for k in range(TAILS)], float)
        self.tail_v = np.array([tails.get(k, (0, 0))[1] for k in range(TAILS)], float)
        self.classes = -(-WORDS // CLASS_SIZE)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Input symbol: rank for common words, WORDS + tail class for others."""
        out = codes.copy()
        high = codes >= self.words
        out[high] = WORDS + tail_of(self.keys[codes[high]])
        low = codes < 0
        out[low] = WORDS + tail_of(codes[low])
        return out

    def tail_log(self) -> np.ndarray:
        return np.log10(self.tail_n + ALPHA * (self.tail_v + 1))


def initial(layout: Layout) -> dict:
    """Parameters that start at the training frequencies."""
    r, h = np.random.default_rng(7), HIDDEN
    c = np.zeros(WORDS)
    c[: layout.words] = layout.counts[: layout.words]
    p_class = np.concatenate([c.reshape(-1, CLASS_SIZE).sum(1), layout.tail_n]) + ALPHA
    word = np.where(np.arange(WORDS) < layout.words, np.log(c + ALPHA), -30.0).reshape(-1, CLASS_SIZE)
    word = word - np.log(np.exp(word).sum(1, keepdims=True))
    p = {
        "x": r.normal(0, 0.3, (WORDS + TAILS + 1, 3 * h)),
        "u": r.normal(0, h**-0.5, (h, 3 * h)),
        "c": np.zeros((h, len(p_class))),
        "cb": np.log(p_class / p_class.sum()),
        "w": np.zeros((WORDS // CLASS_SIZE, h, CLASS_SIZE)),
        "wb": word,
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def lanes(docs: list, most: int = LANES) -> tuple:
    """Documents laid end to end in lanes: (symbols, document, starts a document), all lanes one after another, and the lanes' lengths, falling."""
    most = max(1, min(most, len(docs)))
    load, held = [(0, i) for i in range(most)], [[] for _ in range(most)]
    import heapq

    for d in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        n, i = heapq.heappop(load)
        held[i].append(d)
        heapq.heappush(load, (n + len(docs[d]), i))
    held = sorted((x for x in held if x), key=lambda x: -sum(len(docs[d]) for d in x))
    order = [d for x in held for d in x]
    n = np.array([len(docs[d]) for d in order])
    sym = np.concatenate([docs[d] for d in order]).astype(np.int32, copy=False)
    new = np.zeros(len(sym), bool)
    new[np.cumsum(n) - n] = True
    return sym, np.repeat(np.array(order, np.int32), n), new, np.array([sum(len(docs[d]) for d in x) for x in held])


def sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def recur(p: dict, inputs: np.ndarray, new: np.ndarray, h: np.ndarray, keep: bool) -> tuple:
    """States before each target, the state at the end and, with keep, what backpropagation needs."""
    H, (T, B) = HIDDEN, inputs.shape
    xs = p["x"][inputs]
    u, out, saved = p["u"], np.empty((T, B, H), xs.dtype), []
    starts = new.any(1).tolist()
    for t in range(T):
        if starts[t]:
            h = h * ~new[t][:, None]
        hu = h @ u
        x = xs[t]
        zr = hu[:, : 2 * H] + x[:, : 2 * H]
        sigmoid(zr)
        z, r = zr[:, :H], zr[:, H:]
        n = r * hu[:, 2 * H :]
        n += x[:, 2 * H :]
        np.tanh(n, out=n)
        if keep:
            saved.append((h, hu[:, 2 * H :], z, r, n))
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out, h, saved


def outputs(p: dict, h: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple:
    """Log probability of each target symbol (for tails: of the class) and, with grads, the gradient to h.

    Logits start as log probabilities and stay small, so they are only kept below overflow.
    """
    n_words = WORDS // CLASS_SIZE
    cls = np.where(target < WORDS, target // CLASS_SIZE, n_words + target - WORDS).astype(np.int16)
    order = np.argsort(cls, kind="stable")  # rows by class, so that a class is a slice
    wide = np.ones((len(h), h.shape[1] + 1), h.dtype)  # a last column of ones carries the biases
    wide[:, :-1] = h[order]
    target, cls = target[order], cls[order]
    top, inner = np.vstack([p["c"], p["cb"]]), np.concatenate([p["w"], p["wb"][:, None]], 1)
    # states lie within +-1, so the sum of sizes bounds a logit; cut only where that could overflow
    cut = max(float(np.abs(top).sum(0).max()), float(np.abs(inner).sum(1).max())) > 60
    rows, lp = np.arange(len(wide)), np.empty(len(wide), h.dtype)
    dh = None
    if grads is not None:
        dh = np.empty_like(wide)
        g_top, g_inner = np.zeros_like(top), np.zeros_like(inner)
    for a in range(0, len(wide), _ROWS):  # so many rows at a time stay in the processor's cache
        b = min(len(wide), a + _ROWS)
        e, lp[a:b], total = likelihood(wide[a:b], top, rows[: b - a], cls[a:b], cut)
        if grads is not None:
            e /= total[:, None]
            e[rows[: b - a], cls[a:b]] -= 1
            g_top += wide[a:b].T @ e
            np.matmul(e, top.T, out=dh[a:b])
    edge = np.searchsorted(cls, np.arange(n_words + 1))
    own = target % CLASS_SIZE
    for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if a < b:
            i, j, hk = rows[: b - a], own[a:b], wide[a:b]
            e, more, total = likelihood(hk, inner[k], i, j, cut)
            lp[a:b] += more
            if grads is not None:
                e /= total[:, None]
                e[i, j] -= 1
                np.matmul(hk.T, e, out=g_inner[k])
                dh[a:b] += e @ inner[k].T
    back = np.empty_like(lp)
    back[order] = lp
    if dh is not None:
        grads["c"], grads["cb"], grads["w"], grads["wb"] = g_top[:-1], g_top[-1], g_inner[:, :-1], g_inner[:, -1]
        out = np.empty((len(dh), h.shape[1]), h.dtype)
        out[order] = dh[:, :-1]
        dh = out
    return back, dh


_ROWS = 2048


def likelihood(h: np.ndarray, w: np.ndarray, rows: np.ndarray, at: np.ndarray, cut: bool) -> tuple:
    """(exp of the logits, log probability of the column `at` of each row, sums of the exps), in place."""
    e = h @ w
    if cut:
        np.minimum(e, 60, out=e)
    lp = e[rows, at]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    lp -= np.log(total)
    return e, lp, total


def windows(docs: list, length: int, heads: np.ndarray | None = None, most: int = LANES):
    """(symbols, inputs, new, document, lanes) of each window; lanes that have ended drop out.

    heads: the symbol before each document's first, by default the mark of a beginning.
    """
    sym, doc, new, size = lanes(docs, most)
    before = np.empty_like(sym)
    before[1:] = sym[:-1]
    before[new] = WORDS + TAILS if heads is None else heads[doc[new]]
    start = np.cumsum(size) - size
    for lo in range(0, int(size[0]), length):
        hi = min(int(size[0]), lo + length)
        b = int((size > lo).sum())
        # only this window is laid out: a long text beside short ones takes no room beyond its own
        step = np.arange(lo, hi)[:, None]
        ended = step >= size[:b]
        at = np.minimum(step, size[:b] - 1) + start[:b]
        d, w = doc[at], new[at]
        d[ended], w[ended] = -1, False
        yield sym[at], before[at], w, d, b


def segments(docs: list, length: int = SEGMENT) -> tuple:
    """Documents cut for training, and the symbol before each piece."""
    parts = [d[a : a + length] for d in docs for a in range(0, len(d), length)]
    heads = [WORDS + TAILS if a == 0 else d[a - 1] for d in docs for a in range(0, len(d), length)]
    return parts, np.array(heads, np.int32)


def score(p: dict, docs: list) -> np.ndarray:
    """Natural log probability of each document's symbols, the state carried through all of its windows."""
    out = np.zeros(len(docs))
    h = None
    for target, inputs, new, doc, b in windows(docs, WINDOW, most=4 * LANES):  # each document alone, however many abreast
        h = np.zeros((b, HIDDEN), np.float32) if h is None else h[:b]
        states, h, _ = recur(p, inputs, new, h, False)
        live = doc.ravel() >= 0
        lp, _ = outputs(p, states.reshape(-1, HIDDEN)[live], target.ravel()[live], None)
        out += np.bincount(doc.ravel()[live], lp, len(docs))
    return out


def learn(p: dict, g2: dict, docs: list, rate: float) -> None:
    """One pass of truncated backpropagation over docs; Adagrad on the mean gradient of each window."""
    H, h = HIDDEN, None
    parts, heads = segments(docs)
    for target, inputs, new, doc, b in windows(parts, WINDOW, heads):
        h = np.zeros((b, H), np.float32) if h is None else h[:b]
        states, last, saved = recur(p, inputs, new, h, True)
        T = len(target)
        live = doc.ravel() >= 0
        g: dict = {}
        _, dh_live = outputs(p, states.reshape(-1, H)[live], target.ravel()[live], g)
        dout = np.zeros((T * b, H), np.float32)
        dout[live] = dh_live
        dout = dout.reshape(T, b, H)
        # what each step's gradient is multiplied by, for all steps at once
        hp, hn, z, r, n = (np.stack(x) for x in zip(*saved))
        to_n = (1 - z) * (1 - n * n)
        to_z = (hp - n) * z * (1 - z)
        to_r = hn * r * (1 - r)
        dx, dhu = np.empty((T, b, 3 * H), np.float32), np.empty((T, b, 3 * H), np.float32)
        dh, back, ended = np.zeros((b, H), np.float32), np.ascontiguousarray(p["u"].T), new.any(1).tolist()
        for t in reversed(range(T)):
            dh += dout[t]
            da = dh * to_n[t]
            g_t, x_t = dhu[t], dx[t]
            np.multiply(dh, to_z[t], out=g_t[:, :H])
            np.multiply(da, to_r[t], out=g_t[:, H : 2 * H])
            np.multiply(da, r[t], out=g_t[:, 2 * H :])
            x_t[:, : 2 * H] = g_t[:, : 2 * H]
            x_t[:, 2 * H :] = da
            dh *= z[t]
            dh += g_t @ back
            if ended[t]:
                dh *= ~new[t][:, None]
        g["u"] = hp.reshape(-1, H).T @ dhu.reshape(-1, 3 * H)
        ids = inputs.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        gx, rows = np.add.reduceat(dx.reshape(-1, 3 * H)[order], first), ids[order][first]
        scale = np.float32(1 / max(1, int(live.sum())))
        for k, v in g.items():
            v *= scale
            g2[k] += v * v
            p[k] -= rate * v / np.sqrt(g2[k])
        gx *= scale
        g2["x"][rows] += gx * gx
        p["x"][rows] -= rate * gx / np.sqrt(g2["x"][rows])
        h = last


def grouped(batches, most: int):
    """(from, to, batch) of rows with up to about `most` symbols together."""
    for batch in batches:
        size, lo = np.cumsum(batch.column("n_tokens").to_numpy()), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield lo, hi, batch
            lo = hi


def symbols_of(batch, lo: int, hi: int) -> list:
    return [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int32) for x in batch.column("symbols").slice(lo, hi - lo)]


def encoded(docs: DataFrame, layout: Layout) -> DataFrame:
    """Every row once in numbers: uid, n_tokens, near (tokens of the broadcast table), log and inside (their
    logs for the base and within tail classes), keys and ns (the other words), symbols (uint16 bytes)."""
    send = docs.sparkSession.sparkContext.broadcast(layout)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        lay = send.value
        known = Known(lay.keys)
        uid = TaskContext.get().partitionId() << 40
        log_n, tail_log = np.log10(lay.counts + ALPHA), lay.tail_log()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows: list = [[] for _ in range(7)]
                for c in known.of(part.column("text").to_pylist()):
                    near, far = c[c >= 0], c[c < 0]
                    rare = near[near >= lay.words]
                    # within their classes: known rare words here, unknown and rarest ones after the join
                    inside = log_n[rare].sum() - tail_log[tail_of(lay.keys[rare])].sum() - tail_log[tail_of(far)].sum()
                    k, n = np.unique(far, return_counts=True)
                    for col, x in zip(rows, (len(c), len(near), log_n[near].sum(), inside, k, n, lay.symbols(c).astype(np.uint16).tobytes())):
                        col.append(x)
                m = part.num_rows
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(range(uid, uid + m), pa.int64()), *(pa.array(c, t) for c, t in zip(rows, kinds))],
                    ["doc_id", "uid", "n_tokens", "near", "log", "inside", "keys", "ns", "symbols"],
                )
                uid += m

    schema = f"doc_id {kind}, uid long, n_tokens long, near long, log double, inside double, keys array<long>, ns array<long>, symbols binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32)


def unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_PART = 8192


def averaged(rows: DataFrame) -> np.ndarray:
    """Token-weighted mean of parameter parts (part, w, v float32 bytes), summed in two levels."""

    def total(table):
        w = table.column("w").to_numpy()
        v = sum(x * np.frombuffer(b.as_py(), np.float64) for x, b in zip(np.ones(len(w)), table.column("v")))
        return pa.table({"part": [table.column("part")[0].as_py()], "w": [float(w.sum())], "v": [v.tobytes()]}, pa.schema([("part", pa.int32()), ("w", pa.float64()), ("v", pa.binary())]))

    one = rows.groupBy("part", "salt").applyInArrow(total, "part int, w double, v binary")
    two = one.groupBy("part").applyInArrow(total, "part int, w double, v binary").orderBy("part").collect()  # the parameters, once
    if not two:
        return np.zeros(0, np.float32)
    return np.concatenate([np.frombuffer(r.v, np.float64) / r.w for r in two]).astype(np.float32)


def train(rows: DataFrame, layout: Layout, rounds: int = ROUNDS) -> dict:
    """Parameters after `rounds` slices of encoded rows; every row is in one of them."""
    spark = rows.sparkSession
    p = initial(layout)
    tasks = 2 * spark.sparkContext.defaultParallelism
    slot = F.pmod(F.xxhash64("symbols"), F.lit(1 << rounds)) + 1  # slices of 1/4, 1/4 and 1/2 of the documents
    for i in range(rounds):
        lo, hi = (0 if i == 0 else 1 << i), 1 << (i + 1)
        send = spark.sparkContext.broadcast((pack(p), layout))
        rate = RATE / (1 + i)

        def run(batches):
            flat, lay = send.value
            own = unpack(flat, initial(lay))
            g2 = {k: np.full_like(v, 1e-8) for k, v in own.items()}
            tokens = 0
            for a, b, batch in grouped(batches, 1 << 20):
                docs = symbols_of(batch, a, b)
                learn(own, g2, docs, rate)
                tokens += sum(map(len, docs))
            if tokens:
                v, salt = pack(own).astype(np.float64) * tokens, tokens % 16
                parts = [v[a : a + _PART].tobytes() for a in range(0, len(v), _PART)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([float(tokens)] * n), pa.array(parts, pa.binary())], ["part", "salt", "w", "v"])

        own = rows.filter((slot > lo) & (slot <= hi)).select("n_tokens", "symbols").coalesce(tasks)
        flat = averaged(own.mapInArrow(run, "part int, salt int, w double, v binary"))
        if len(flat):
            p = unpack(flat, p)
        send.unpersist()
    return p


def commonest(counts: DataFrame, most: int) -> list:
    """Rows of at most `most` of the commonest words and of the end mark. Words are told by a filter on their
    counts, from a histogram over logarithmic bins of counts (16,384 at most), so the driver gets no more
    than it keeps. A bin that would exceed `most` stays out whole; its words are counted by the join."""
    end = word_key(END)
    level = F.floor(F.log2(F.col("n").cast("double")) * 256).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    cut, left = 1 << 20, most - 1
    for r in sorted(bins, reverse=True):
        if r.words > left:
            break
        cut, left = r.level, left - r.words
    return counts.filter((level >= cut) | (F.col("key") == end)).collect()


def layout_of(counts: DataFrame) -> Layout:
    """Ranks, counts and tail sums from the counts table."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = word_key(END)
    top = commonest(counts, COUNTED)
    top.sort(key=lambda r: (-r.n, r.key))
    at = next((i for i, r in enumerate(top) if r.key == end), None)
    if at is not None and at >= WORDS:
        top.insert(WORDS - 1, top.pop(at))
    tail = F.shiftrightunsigned("key", 59).bitwiseAND(F.lit(TAILS - 1))
    tails = {r.k: [r.n, r.v] for r in counts.groupBy(tail.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for r in top[:WORDS]:
        k = int(tail_of(np.array([r.key]))[0])
        tails[k][0] -= r.n
        tails[k][1] -= 1
    return Layout([r.key for r in top], [r.n for r in top], WORDS, int(n), int(v), tails)


def held_out(folds: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def scored(rows: DataFrame, layout: Layout, p: dict, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every encoded row."""
    send = rows.sparkSession.sparkContext.broadcast((pack(p), layout))

    def run(batches):
        flat, lay = send.value
        own = unpack(flat, initial(lay))
        for lo, hi, batch in grouped(batches, _CHUNK_TOKENS):
            part = score(own, symbols_of(batch, lo, hi)) / np.log(10)
            names = ["doc_id", "uid", "n_tokens", "near", "log", "inside"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(part)], [*names, "part"])

    kinds = dict(rows.dtypes)
    names = ["doc_id", "uid", "n_tokens", "near", "log", "inside"]
    parts = rows.select(*names, "symbols").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", part double")
    rare = rows.select("uid", F.explode(F.arrays_zip("keys", "ns")).alias("x")).select("uid", F.col("x.keys").alias("key"), F.col("x.ns").alias("m"))
    seen = rare.join(counts, "key", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("far"),
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("far_log"),
    )
    norm = float(np.log10(layout.total + ALPHA * (layout.distinct + 1)))
    far, far_log = F.coalesce("far", F.lit(0)), F.coalesce("far_log", F.lit(0.0))
    return parts.join(seen, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("near") + far).alias("n_known"),
        (F.col("log") + far_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("part") + F.col("inside") + far_log).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    A null or empty text has one token, the end. A very long text is scored from its first word to its end,
    the state carried through. A null doc_id is held out. Repeated rows score alike. Words of equal counts
    (ties) are ranked by their keys. Without training documents all tokens are unknown and the model's probabilities are its initial
    ones. An empty table gives no rows. Extra columns are ignored.
    """
    counts = stage(corpus_counts(docs.filter(~held_out(folds))), "lm-counts")
    layout = layout_of(counts)
    rows = stage(encoded(docs, layout), "lm-rows")
    p = train(rows.filter(~held_out(folds)), layout, rounds)
    out = scored(rows, layout, p, counts)
    return out.select("doc_id", held_out(folds).alias("held_out"), "n_tokens", "n_known", F.lit(layout.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language(spark, sf_dir) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
