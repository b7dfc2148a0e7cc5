"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of hashed words and word prefixes, a
document's is the noisy-or 1 - prod(1 - q): one offending sentence suffices. q is what a sentence's score
exceeds that of one without learnt words, so that no number of clean sentences makes a text toxic.
Weights are learnt from document labels alone, by minimising the noisy-or's log loss with Adagrad; there
each document also has the chance LEAK of its label for no sentence's sake.
The model is fitted in one task on a bounded sample (FIT_DOCS labelled documents, least hash first);
scoring covers every sentence of every text.
"""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, sample_by_hash

FIT_DOCS = 12_000
FIT_BYTES = 64_000_000
BITS = 20
PRIOR = LEAK = 0.02
UNTAUGHT = -30.0  # bias without labels of both kinds: even long texts score near 0
EPOCHS = 12
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|!!\s+|\s\|\s")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list:
    """(start, end) in code points of the sentences that hold a word; they cover all words of the text."""
    text = text or ""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((at, end))
        at = m.end() if m else end
    return out


def features(word: str) -> tuple:
    """Hashes of a lower-case word and of its prefixes, which catch inflected and compound forms."""
    forms = [word + "$", *("^" + word[:k] for k in range(4, min(8, len(word)) + 1))]
    return tuple(zlib.crc32(x.encode()) >> (32 - BITS) for x in forms)


class Forms(dict):
    """Features of words that `use` marks (all without it). Remembers a bounded number of words."""

    def __init__(self, use: np.ndarray | None = None):
        super().__init__()
        self.use = use

    def __missing__(self, word: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        found = features(word)
        self[word] = found = found if self.use is None else tuple(f for f in found if self.use[f])
        return found


def associations(texts: list, labels: np.ndarray) -> tuple:
    """Documents, and documents with the label, of each feature."""
    df, pos, forms = np.zeros(1 << BITS), np.zeros(1 << BITS), Forms()
    for text, y in zip(texts, labels):
        own = {w for a, b in sentences(text) for w in _WORD.findall(text[a:b].lower())}
        ids = list({f for w in own for f in forms[w]})
        df[ids] += 1
        pos[ids] += y
    return df, pos


def bags(texts: list, use: np.ndarray) -> tuple:
    """(features that `use` marks, their sentences, sentences' documents)"""
    feats, sent, doc, forms = [], [], [], Forms(use)
    for i, text in enumerate(texts):
        for a, b in sentences(text):
            for w in _WORD.findall(text[a:b].lower()):
                if f := forms[w]:
                    feats.extend(f)
                    sent.extend([len(doc)] * len(f))
            doc.append(i)
    return np.array(feats, np.int32), np.array(sent, np.int32), np.array(doc, np.int64)


def logits(texts: list, weights: np.ndarray, cache: dict) -> tuple:
    """Summed weights of each sentence and the sentences' documents. cache: weights by word."""
    out, doc = [], []
    if len(cache) > 500_000:
        cache.clear()
    for i, text in enumerate(texts):
        for a, b in sentences(text):
            words = _WORD.findall(text[a:b].lower())
            for w in words:
                if w not in cache:
                    cache[w] = float(weights[list(features(w))].sum())
            out.append(sum([cache[w] for w in words]))
            doc.append(i)
    return np.array(out, float), np.array(doc, np.int64)


def noisy_or(weights: np.ndarray, bias: float, bag: tuple, docs: int) -> tuple:
    """Score of each document, the chance LEAK included, and summed weights of each sentence."""
    f, s, d = bag
    z = np.bincount(s, weights[f], len(d))
    P, _ = combined(z, bias, d, docs)
    return 1 - (1 - LEAK) * (1 - P), z


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def combined(z: np.ndarray, bias: float, d: np.ndarray, docs: int) -> tuple:
    """Score of each document and of each sentence: what is over the score of a sentence without learnt words."""
    p = np.log1p(-np.minimum(logistic(np.append(z, 0.0) + bias), 1 - 1e-12))
    none = np.minimum(p[:-1] - p[-1], 0)
    return -np.expm1(np.bincount(d, none, docs)), -np.expm1(none)


def fit(texts: list, labels: np.ndarray, l2: float = 1e-4, rate: float = 0.3) -> tuple:
    """(weights, bias) from document labels. Features of fewer than 3 documents get no weight."""
    if not len(labels) or not 0 < labels.sum() < len(labels):
        return np.zeros(1 << BITS), UNTAUGHT
    df, pos = associations(texts, labels)
    # start from the words' association with the label; one threshold for all, by the size of the sample
    base = labels.mean()
    z = (pos - df * base) / np.sqrt(np.maximum(df, 1) * base * (1 - base))
    f, s, d = bags(texts, (df >= 3) & (np.abs(z) > np.sqrt(2 * np.log(1 << BITS))))
    order = np.random.default_rng(0).permutation(len(labels))
    first_sentence = np.searchsorted(d, np.arange(len(labels) + 1))
    first_feature = np.searchsorted(s, first_sentence)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    per_doc = max(1.0, len(d) / len(labels))
    bias, b2 = float(np.log(PRIOR / per_doc)), 1e-6
    for epoch in range(EPOCHS):
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            fs = [f[first_feature[i] : first_feature[i + 1]] for i in part]
            n = first_sentence[part + 1] - first_sentence[part]
            at = np.concatenate([[0], np.cumsum(n)])
            ss = [s[first_feature[i] : first_feature[i + 1]] - first_sentence[i] + at[k] for k, i in enumerate(part)]
            bf, bs, bd = np.concatenate(fs), np.concatenate(ss).astype(np.int64), np.repeat(np.arange(len(part)), n)
            if not len(bf):  # nothing to learn from: all sentences are background
                continue
            P, z = noisy_or(w, bias, (bf, bs, bd), len(part))
            y, p = labels[part], logistic(z + bias)
            # d loss / d logit of a sentence: p where y is 0, -p (1 - P) / P where it is 1; none below the background
            per = np.where(y[bd] > 0, -((1 - P) / np.maximum(P, 1e-9))[bd], 1.0) * (z >= 0)
            g = per * p
            u, inverse = np.unique(bf, return_inverse=True)
            gw = np.bincount(inverse, g[bs], len(u)) + l2 * w[u]
            g2[u] += gw * gw
            w[u] -= rate * gw / np.sqrt(g2[u])
            gb = (per * (p - logistic(bias))).sum()
            b2 += gb * gb
            bias -= rate * gb / np.sqrt(b2)
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> tuple:
    """(weights, bias) fitted in one task on at most fit_docs labelled rows of docs and fit_bytes bytes of their
    text, least hash of the id first; the driver gets the weights only. A text that does not fit is left
    out alone, and a warning tells how many were. Without labels of both kinds there is nothing to fit."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y is not null and _id is not null")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    known = docs.select("doc_id").join(marked, F.col("doc_id") == F.col("_id")).select("_id", "_y").distinct()
    chosen = sample_by_hash(known, F.xxhash64("_id"), fit_docs)
    sample = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def run(batches):
        texts, ys, left, skipped = [], [], fit_bytes, 0
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("_y").to_pylist()):
                t = t.as_py() or ""
                size = len(t.encode())
                if size > left or len(texts) >= fit_docs:  # a text that does not fit takes nothing from those after it
                    skipped += 1
                    continue
                left -= size
                texts.append(t)
                ys.append(float(y > 0))
        w, bias = fit(texts, np.array(ys))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(w[at], [bias, skipped]))], ["f", "w"])

    weights, bias = np.zeros(1 << BITS), UNTAUGHT
    for f, w in sample.mapInArrow(run, "f long, w double").collect():
        if f == -1:
            bias = w
        elif f == -2:
            if w:
                warnings.warn(f"{int(w)} labelled texts did not fit the sample of {fit_docs} texts and {fit_bytes} bytes", stacklevel=2)
        else:
            weights[f] = w
    return weights, bias


def scored(docs: DataFrame, model: tuple, extra: tuple = (), locate: bool = True) -> DataFrame:
    """The columns `extra`, doc_id, score and, with locate, the spans of sentences scored 0.5 or more."""
    weights, bias = model
    at = np.flatnonzero(weights)
    send = docs.sparkSession.sparkContext.broadcast((at, weights[at], bias))  # at most 2^BITS weights
    keep = list(dict.fromkeys([*extra, "doc_id"]))

    def run(batches):
        at, w, bias = send.value
        full, cache = np.zeros(1 << BITS), {}
        full[at] = w
        for batch in batches:
            texts = batch.column("text")
            score, spans = np.zeros(len(texts)), []
            for lo in range(0, len(texts), 512):
                part = [t or "" for t in texts.slice(lo, 512).to_pylist()]
                z, d = logits(part, full, cache)
                P, p = combined(z, bias, d, len(part))
                score[lo : lo + len(part)] = P
                found: list = [[] for _ in part]
                hot = set(d[p >= 0.5].tolist()) if locate else ()
                for i in hot:
                    lo_s, hi_s = np.searchsorted(d, [i, i + 1])
                    found[i] = [{"s": a, "e": b, "score": float(x)} for (a, b), x in zip(sentences(part[i]), p[lo_s:hi_s]) if x >= 0.5]
                spans.extend(found)
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.clip(score, 0, 1)), pa.array(spans, kind)], [*keep, "score", "offending"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, offending array<struct<s:long,e:long,score:double>>"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(folds: int = 5):
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted and offending for every row.

    Null and empty texts have no sentence and score 0. A very long text is scored whole, and its clean
    sentences add nothing. Repeated rows score alike, rows that share an id each by its text. A null doc_id
    is held out. Without labels of both kinds all scores are near 0. An empty table gives no rows. Extra
    columns are ignored.
    """
    model = learn(docs.filter(~held_out(folds)), labels)
    out = scored(docs, model)
    return out.select("doc_id", held_out(folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op8_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending")
    )
