import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitloom.llm import chat, neighbours
from fitloom.llm.packing import tokenizer_path

# ---- chat ----


@given(st.text(max_size=60))
def test_escapes_are_reversible(t):
    for text in (t, "\\### Assistant: </turn> ok" + t, "\\\\" + t + "### </turn>\\"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.unescape(chat.escape(text, True), True) == text


def test_turns_come_back_from_tokens(spark):
    data = [
        (1, 1, "assistant", "hi </turn> ### \\ there"), (1, 0, "user", "x" * 5000), (2, 0, "assistant", None), (2, 0, "assistant", ""), (None, 0, "user", "é한 <|endoftext|>"),
        (3, None, None, "a"), (3, 0, "user", "b"), (3, 0, "user", "b"), (4, 0, "we: ird\n### ", "t"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("mask", F.lit(2))
    path = tokenizer_path(chat.VOCABULARY)
    ids = chat.formatted(df, path)
    got = {r.conv_id: r for r in chat.read_back(ids, path).collect()}
    turns = {1: [data[1], data[0]], 2: data[2:4], None: [data[4]], 3: [data[5], data[6], data[7]], 4: [data[8]]}
    for conv, own in turns.items():
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(4 + 2 + 8 + len(chat.escape(x or "", True)) + len(chat.escape(t or "")) for _, _, x, t in own)
    assert chat.read_back(chat.formatted(df.limit(0), path), path).count() == 0
    turns = chat.offsets(ids).filter("conv_id = 1").orderBy("start").collect()
    assert [r.turn for r in turns] == [0, 1] and [r.start for r in turns] == [0, len(turns[0].ids)]


# ---- neighbours ----


def brute(vectors, k, asks):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    out = {}
    for q in asks:
        if q in ok:
            score = [(round(float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), 10), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = [i for _, i in sorted(score, key=lambda x: (-x[0], x[1]))[:k]]
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_search_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    r = np.random.default_rng(6)
    vectors = {i: [float(np.float32(x)) for x in r.normal(size=12)] for i in range(150)}
    for i in range(60, 80):
        vectors[i] = vectors[5]  # ties beyond k
    for i in range(80, 90):
        vectors[i] = [float(np.float32(x + 1e-4 * r.normal())) for x in vectors[10]]
    vectors |= {200: None, 205: [0.0] * 12, 210: [math.nan] * 12, 215: [math.inf] + [1.0] * 11, 220: [1.0, 2.0], 225: [None] + [1.0] * 11, 230: [2.0, 4.0]}
    data = [(i, v, 1, "x") for i, v in vectors.items()] + [(7, vectors[7], 1, "x"), (None, vectors[8], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, key int, vec string")
    got = neighbours.search(df, F.col("id") % 5 == 0).collect()
    have = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        have.setdefault(x.query_id, []).append(x.vec_id)
    assert have == {q: v for q, v in brute(vectors, 5, [i for i in vectors if i % 5 == 0]).items() if v}
    assert neighbours.search(df.limit(0), F.col("id") % 5 == 0).count() == 0


@pytest.mark.parametrize("copies", [2, 60])
def test_an_id_with_several_vectors_is_listed_once(spark, copies):
    r = np.random.default_rng(8)
    vec = lambda: [float(np.float32(x)) for x in r.normal(size=6)]
    data = [(i, vec()) for i in range(40)]
    near = data[0][1]
    data += [(7, [float(np.float32(x + 1e-3 * r.normal())) for x in near]) for _ in range(copies)]  # crowd query 0
    data += [(20, vec()), (9, data[11][1]), (9, data[11][1])]  # a query with two vectors; a vector of two ids
    got = {}
    for x in neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in (0, 20):
        best: dict = {}
        for i, v in data:
            for j, w in data:
                if i == q != j:
                    a, b = np.array(v), np.array(w)
                    best[j] = max(best.get(j, -2), float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
        want = sorted(best.items(), key=lambda x: (-round(x[1], 10), x[0]))[:5]
        assert [(i, n) for i, n, _ in sorted(got[q])] == [(k + 1, n) for k, (n, _) in enumerate(want)]
        np.testing.assert_allclose([s for *_, s in sorted(got[q])], [s for _, s in want], rtol=1e-12)


def test_bounds_hold():
    r = np.random.default_rng(7)
    a = neighbours.unit(r.normal(size=(40, 1500)))
    q, s, e = neighbours.quantise(a)
    near = neighbours.products(q, q) * s[:, None] * s[None, :]
    assert (np.abs(near - a @ a.T) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


def test_new_words_are_encoded_without_offsets_and_once():
    """Words are those of the tokenizer, whatever they end in; a word that is known is not learnt again."""
    from fitloom.llm import packing

    e = packing.WordEncoder(packing.tokenizer_path())

    class Batches:
        encode_batch_fast = staticmethod(e.tokenizer.encode_batch_fast)

    texts = ["Plain words, and wörds! ÉTÉ İstanbul ß ŉ x..., 12.5 a-b (c) $$$  nb　sp", "plain words", None, "<|x|> odd"]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    e.tokenizer = Batches()
    assert e.encode(texts) == want
    e._learn = None
    assert e.encode(texts) == want
