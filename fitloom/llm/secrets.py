"""Secret scans: base patterns and a character convolutional network.

Base findings (kinds assign, access, hex) come from fixed patterns. Every other run of 8 or more token
characters with a digit, or with small and inner capital letters, is a candidate: the network reads its
characters with CONTEXT around them, a long run in overlapping windows of which the highest counts.

It is trained on labelled findings: candidates inside base findings, and secrets of other shapes planted
into the corpus's own contexts (one beside every candidate, at a place of the text that its hash picks), are
positive; the other candidates, of which few are secrets, are negative. Half of the positives are shown
without their left context, so that the token itself must tell. The fit takes a bounded sample (FIT
different windows of each kind, least hash first); calibration (Platt) and threshold (the highest that keeps
RECALL of the held-out positives of either kind) are computed from the scores of all held-out candidates.
Candidates at the threshold or above that touch no base finding are added as kind `model`.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, sample_by_hash, stage, unstage
from .repeats import utf8

KINDS = ("assign", "access", "hex", "model")
FIT = 4000
RECALL = 0.99
FOLDS = 4
LEFT, BODY, RIGHT = 24, 56, 16
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = 8
OTHER, BASE, PLANTED = 0, 1, 2  # labels of windows
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
_LIKELY = re.compile(r"[0-9]|[a-z].*[A-Z]|.[A-Z].*[a-z]")
_GAP = re.compile(r"(?<![A-Za-z0-9+/_=.-])\s")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOOK = 1 << 20
_STEMS = (b"passw", b"secret", b"token", b"api", b"akia")
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True
_HEXES = np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_DIGITS, _CAPITALS, _SMALL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGITS[[ord(c) for c in "0123456789"]] = True
_CAPITALS[[ord(c) for c in _UPPER]] = True
_SMALL[[ord(c) for c in _LOWER]] = True


def base_findings(text: str) -> list:
    """[(kind, start, end)] in code points, by start, then kind."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[1], x[0]))


def window(text: str, a: int, b: int, body: str) -> str:
    """`body` with what stands before a and after b."""
    return text[max(0, a - LEFT) : a].rjust(LEFT, "\0") + body.ljust(BODY, "\0") + text[b : b + RIGHT].ljust(RIGHT, "\0")


def candidates(text: str, base: list) -> list:
    """[(start, end, in a base finding, windows)] of every candidate. base: as base_findings() gives it, by start."""
    out, k, reach = [], 0, -1
    for m in _CANDIDATE.finditer(text):
        if _LIKELY.search(m.group()):
            a, b = m.span()
            while k < len(base) and base[k][1] < b:
                reach = max(reach, base[k][2])
                k += 1
            starts = range(a, max(a + 1, b - BODY // 2), BODY // 2)  # all of the run, by windows that overlap
            out.append((a, b, a < reach, [window(text, i, min(b, i + BODY), text[i : min(b, i + BODY)]) for i in starts]))
    return out


def synthetic(r: random.Random) -> str:
    """A secret of a shape that the base patterns need not know: keys of letters and digits in several alphabets
    and lengths, with and without a prefix, in groups, or in three parts. Never of digits alone."""
    some = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    both = _UPPER + _LOWER + "0123456789"
    shape = r.randrange(8)
    if shape == 0:
        return some("0123456789ABCDEF", r.choice((32, 40, 64)))
    if shape == 1:
        return some(both + "+/", r.randrange(24, 65)) + r.choice(("", "=", "=="))
    if shape == 2:
        return some(both + "-_", r.randrange(20, 57))
    if shape == 3:
        return "-".join(some(r.choice(("0123456789abcdef", both)), n) for n in (8, 4, 4, 4, 12))
    if shape == 4:
        return some(_LOWER, r.randrange(2, 5)) + r.choice("_-") + r.choice(("", "live_", "test-", "pat_")) + some(both, r.randrange(20, 41))
    if shape == 5:
        return ".".join(some(both + "-_", n) for n in (r.randrange(12, 37), r.randrange(20, 61), r.randrange(20, 44)))
    if shape == 6:
        return some(_UPPER, r.randrange(2, 5)) + some(_UPPER + "0123456789", r.randrange(16, 33))
    return "".join(r.sample(some(_UPPER, 3) + some(_LOWER, 5) + some("0123456789", 3) + some("+/_=.-", r.randrange(0, 3)), k=11))


def planted(text: str, seed: int) -> str:
    """A window of a synthetic secret at a place between words of the text; seed tells which secret and place."""
    r = random.Random(seed)
    at = r.randrange(len(text))
    gap = _GAP.search(text, at) or _GAP.search(text)
    at = gap.end() if gap else 0
    quote = r.choice(("", "", '"', "'", ": ", "= "))
    body = synthetic(r)
    left = (text[max(0, at - LEFT) : at] + quote)[-LEFT:]
    return left.rjust(LEFT, "\0") + body[:BODY].ljust(BODY, "\0") + (quote[:1].strip(":= ") + " " + text[at : at + RIGHT])[:RIGHT].ljust(RIGHT, "\0")


def worth(column) -> np.ndarray:
    """Which texts can hold a finding or a candidate; whole texts are looked at together, about _LOOK bytes at a time."""
    data, offsets = utf8(column)
    hit, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _LOOK, "right")) - 1)
        hit.append(worth_together(data, offsets[i : j + 1]))
        i = j
    return np.concatenate(hit) if hit else np.zeros(0, bool)


def worth_together(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One vectorised look at the bytes of several texts."""
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = data[lo:hi]
    hit = np.zeros(n, bool)
    if not len(data):
        return hit
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1] - lo] = True
    digits, capitals, small = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_DIGITS, _CAPITALS, _SMALL))
    for table, least, likely in ((_TOKEN, LEAST, True), (_HEXES, 32, False)):
        m = table[data]
        edge = np.flatnonzero(m & (first[:-1] | ~np.concatenate([[False], m[:-1]])))
        stop = np.flatnonzero(m & (first[1:] | ~np.concatenate([m[1:], [False]]))) + 1
        long = stop - edge >= least
        if likely:
            mixed = (capitals[stop] > capitals[edge + 1]) & (small[stop] > small[edge])
            long &= (digits[stop] > digits[edge]) | mixed
        hit[np.searchsorted(offsets, edge[long] + lo, "right") - 1] = True
    low = data.tobytes().lower()
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            i = int(np.searchsorted(offsets, at + lo, "right")) - 1
            hit[i] = True
            at = low.find(stem, int(offsets[i + 1]) - lo)
    return hit


class Network:
    """Embedding, one convolution over characters, maxima by region, logistic output."""

    WIDTH, DIM, FILTERS = 5, 8, 16

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (128, self.DIM)),
            "w": r.normal(0, (self.WIDTH * self.DIM) ** -0.5, (self.WIDTH * self.DIM, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "o": r.normal(0, 0.1, 4 * self.FILTERS),
            "c": np.zeros(1),
        }
        n = LEFT + BODY + RIGHT - self.WIDTH + 1
        self.regions = (slice(0, LEFT), slice(LEFT, LEFT + BODY), slice(LEFT + BODY - self.WIDTH, n))

    @staticmethod
    def codes(windows: list) -> np.ndarray:
        n = LEFT + BODY + RIGHT
        return np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, n).clip(0, 127).astype(np.int16)

    def forward(self, x: np.ndarray) -> tuple:
        e = self.p["e"][x]
        n, k = e.shape[1] - self.WIDTH + 1, self.WIDTH * self.DIM
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(-1, k)
        h = np.maximum((cols @ self.p["w"] + self.p["b"]).reshape(len(x), n, -1), 0)
        peak = [h[:, r].argmax(1) + r.start for r in self.regions]
        f = np.concatenate([np.take_along_axis(h, p[:, None], 1)[:, 0] for p in peak] + [h[:, self.regions[1]].mean(1)], 1)
        return f @ self.p["o"] + self.p["c"], (cols, h, peak, f)

    def logit(self, windows: list) -> np.ndarray:
        out = [self.forward(self.codes(windows[i : i + 1024]))[0] for i in range(0, len(windows), 1024)]
        return np.concatenate(out) if out else np.zeros(0)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        z, (cols, h, peak, f) = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = {"o": f.T @ d, "c": np.array([d.sum()])}
        df = (d[:, None] * self.p["o"]).reshape(len(x), 4, -1)
        dh = np.zeros_like(h)
        rows, chans = np.arange(len(x))[:, None], np.arange(h.shape[2])[None, :]
        for i, p in enumerate(peak):
            np.add.at(dh, (rows, p, chans), df[:, i])
        dh[:, self.regions[1]] += df[:, 3][:, None] / BODY
        dh = (dh * (h > 0)).reshape(-1, h.shape[2])
        g["w"], g["b"] = cols.T @ dh, dh.sum(0)
        dc = (dh @ self.p["w"].T).reshape(len(x), h.shape[1], self.WIDTH, self.DIM)
        g["e"] = np.zeros_like(self.p["e"])
        for k in range(self.WIDTH):
            np.add.at(g["e"], x[:, k : k + h.shape[1]], dc[:, :, k])
        return g

    def fit(self, windows: list, labels: np.ndarray, epochs: int = 8, rate: float = 0.01) -> None:
        x, r = self.codes(windows), np.random.default_rng(1)
        weight = len(labels) / (2 * np.bincount(labels.astype(int), minlength=2))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(max(epochs, -(-400 * 64 // max(1, len(labels))))):
            for part in np.array_split(r.permutation(len(labels)), max(1, len(labels) // 64)):
                own = r.choice(part, len(part), p=(w := weight[labels[part].astype(int)]) / w.sum())
                xb = x[own].copy()
                xb[r.random(len(own)) < 0.5, :LEFT] = 0
                t += 1
                for k, g in self.gradient(xb, labels[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                if t >= 1500:
                    return


def labelled(docs: DataFrame) -> DataFrame:
    """label (OTHER, BASE or PLANTED), window and h (a hash of the window) of every candidate of every text, and of
    as many planted secrets."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            label, found = [], []
            for i in np.flatnonzero(worth(text)).tolist():
                t = text[i].as_py()
                for *_, y, ws in candidates(t, base_findings(t)):
                    label += [BASE if y else OTHER] * len(ws) + [PLANTED]
                    found += [*ws, planted(t, zlib.crc32(ws[0].encode()))]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(found, pa.string())], ["label", "window"])

    return docs.select("text").mapInArrow(run, "label int, window string").withColumn("h", F.xxhash64("window"))


def fitting_sample(found: DataFrame, fit: int) -> DataFrame:
    """About `fit` different windows of each label, least hash first: copies of a window count once."""
    once = found.select("label", "window", "h").distinct()
    some = lambda y: sample_by_hash(once.filter(F.col("label") == y), F.col("h"), fit)
    return some(OTHER).unionByName(some(BASE)).unionByName(some(PLANTED))


def train(docs: DataFrame, fit: int = FIT, recall: float = RECALL) -> dict | None:
    """Network parameters, calibration and threshold; None without candidates of either label.

    Null and empty texts have no candidates. All windows of a very long text take part. Copies of a text
    count once in the fit, each in calibration and threshold. Extra columns are ignored.
    """
    found = stage(labelled(docs), "secrets-candidates")
    held = F.pmod(F.col("h"), F.lit(FOLDS)) == 0
    # the sample is of the least hashes, the folds of the last digits: both are kept apart by another hash
    sample = fitting_sample(found.filter(~held).withColumn("h", F.xxhash64("h")), fit).repartition(1).sortWithinPartitions("h", "window", "label")

    def run(batches):
        windows: list = []
        labels: list = []
        left = {OTHER: fit, BASE: fit, PLANTED: fit}
        for batch in batches:
            for y, w in zip(batch.column("label").to_pylist(), batch.column("window").to_pylist()):
                if left[y]:
                    left[y] -= 1
                    windows.append(w)
                    labels.append(float(y != OTHER))
        y = np.array(labels)
        if not 0 < y.sum() < len(y):
            return
        net = Network()
        net.fit(windows, y)
        names = list(net.p)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net.p[k].ravel() for k in names], pa.list_(pa.float64()))], ["name", "value"])

    weights = {r.name: np.array(r.value) for r in sample.mapInArrow(run, "name string, value array<double>").collect()}
    if not weights:
        unstage(found)
        return None
    shapes = {k: v.shape for k, v in Network().p.items()}
    model = {k: v.reshape(shapes[k]) for k, v in weights.items()}
    send = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        net = Network()
        net.p = send.value
        for batch in batches:
            z = net.logit(batch.column("window").to_pylist())
            bins = pa.array(np.floor(np.clip(z, -40, 40) * 25).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("held"), bins], ["label", "held", "bin"])

    # scores of all candidates, as counts in bins of 0.04; the held-out ones decide for each label that has any
    scored = found.withColumn("held", held).select("label", "held", "window").mapInArrow(score, "label int, held boolean, bin int")
    bins = scored.groupBy("label", "held", "bin").agg(F.count("*").alias("n")).collect()
    unstage(found)
    own = {y: [x for x in bins if x.label == y and x.held] or [x for x in bins if x.label == y] for y in (OTHER, BASE, PLANTED)}
    cut = min(kept(own[y], recall) for y in (BASE, PLANTED) if own[y])
    every = [x for rows in own.values() for x in rows]
    at, n, y = (np.array(c, float) for c in zip(*((x.bin / 25, x.n, x.label != OTHER) for x in every)))
    return model | {"cut": cut, "platt": platt(at, n, y)}


def kept(bins: list, recall: float) -> float:
    """The highest score that keeps the share `recall` of the counted ones."""
    at, n = np.array([x.bin for x in bins]) / 25, np.array([x.n for x in bins], float)
    order = np.argsort(-at)
    total = np.cumsum(n[order])
    return float(at[order][np.searchsorted(total, recall * total[-1] - 1e-9)])


def platt(z: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple:
    """Slope and offset of the logistic that turns scores into probabilities, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = x.T @ (n * (p - y)) + 1e-3 * np.array([a, b])
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def scan(docs: DataFrame, model: dict | None, keep: tuple, redact: str | None = None) -> DataFrame:
    """The columns `keep` and findings: array of kind, s, e, p (code points, end exclusive; p is 1 for base kinds).

    With redact, `text` among them has every finding replaced by that string and stays null where it was.
    A null text is empty. A very long text is read whole. Repeated rows give repeated results, rows that
    share an id each its own; an empty table gives no rows. Extra columns are ignored.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches):
        model, net = send.value, Network()
        if model:
            net.p = {k: model[k] for k in net.p}
        for batch in batches:
            text = batch.column("text")
            found: list = [[] for _ in range(len(text))]
            changed = {}
            new: list = []
            for i in np.flatnonzero(worth(text)).tolist():
                t = text[i].as_py()
                base = base_findings(t)
                found[i] = [(k, s, e, 1.0) for k, s, e in base]
                if model:
                    new += [(i, a, b, ws) for a, b, y, ws in candidates(t, base) if not y]
            if new:
                z = net.logit([w for *_, ws in new for w in ws])
                first = np.cumsum([0, *(len(ws) for *_, ws in new)])[:-1]
                a, b = model["platt"]
                for (i, s, e, _), v in zip(new, np.maximum.reduceat(z, first)):
                    if v >= model["cut"]:
                        found[i].append((3, s, e, float(1 / (1 + np.exp(-np.clip(a * v + b, -30, 30))))))
            for i, spans in enumerate(found):
                if len(spans) > 1:
                    spans.sort(key=lambda x: (x[1], x[0]))
                if spans and redact is not None:
                    t, out, at = text[i].as_py(), [], 0
                    for _, s, e, _ in spans:
                        if s >= at:
                            out += [t[at:s], redact]
                        at = max(at, e)
                    changed[i] = "".join([*out, t[at:]])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("p", pa.float64())]))
            rows = pa.array([[{"kind": KINDS[k], "s": s, "e": e, "p": p} for k, s, e, p in x] for x in found], kind)
            cols = [batch.column(c) for c in keep]
            if changed and "text" in keep:
                at = np.array(sorted(changed))
                mask = np.zeros(len(text), bool)
                mask[at] = True
                own = pa.array([changed[i] for i in at.tolist()], text.type)
                cols[keep.index("text")] = pa.compute.replace_with_mask(text, pa.array(mask), own)
            yield pa.RecordBatch.from_arrays([*cols, rows], [*keep, "findings"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", findings array<struct<kind:string,s:long,e:long,p:double>>"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def joined(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(out: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base findings, and all spans."""
    base = F.filter("findings", lambda x: x["kind"] != "model")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("findings").alias("spans"))


def op6_secrets(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs), ("doc_id",)))
