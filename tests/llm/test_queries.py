"""Every query on tables with null and repeated ids, null, empty and very long texts, ties and extra columns, and on
empty tables; queries with SQL against it."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from fitloom.llm import common, mixing, packing, registry, toxicity
from tests.llm.data import SCHEMA, rows
from tests.llm.test_text_ops import brute_fingerprint, brute_repeats, check_packing
from tests.llm.test_vectors import answers, brute_top

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int, score string"
TURNS = "conv_id long, turn int, role string, text string, ids string"


def vectors():
    r = np.random.default_rng(1)
    v = [(i, [float(x) for x in r.normal(size=8)], i % 3, "k") for i in range(120)]
    return [*v, (50, None, 0, "k"), (100, [0.0] * 8, 0, "k"), (7, v[50][1], 0, "k"), (None, v[3][1], 0, "k")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, keep in (("edge", True), ("empty", False)):
        d = str(tmp_path_factory.mktemp(name))
        texts = [*rows(), (3, "another text for an id that is taken", "en", "s1", 36, 1, 0.5, 2, "k", 3), (None, None, None, None, None, None, None, None, None, None)]
        tables = {
            "documents": (texts, SCHEMA),
            "labels": ([(i, 1, int(i % 4 == 0), "x") for i in range(40)] + [(None, 1, 1, "x"), (5, 1, None, "x"), (999, 1, 1, "x")], LABELS),
            "embeddings": (vectors(), "vec_id long, embedding array<float>, label int, key string"),
            "conversations": ([(c, t, ("user", "assistant")[t % 2], text, "x") for c in (1, 2) for t, text in enumerate(["hi", None, "### x", "a\\b </turn>"])] + [(3, 0, "user", "word " * 20_000, "x")], TURNS),
        }
        for table, (data, schema) in tables.items():
            spark.createDataFrame(data if keep else [], schema).write.parquet(f"{d}/{table}.parquet")
        out[name] = d
    return out


def digest(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, folders, name):
    got = registry.QUERIES[name](spark, folders["empty"]).collect()
    assert len(got) == (1 if name == "op7_chat" else 0)  # the conversation that is always there


def edge(spark, folders, name):
    got = registry.QUERIES[name](spark, folders["edge"]).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folders['edge']}/documents.parquet").collect()]
    assert name == "op9_packing" or len(got) == len(texts)
    return got, texts


def test_op1(spark, folders):
    got, texts = edge(spark, folders, "op1_media")
    want = []
    for i, t in texts:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((str(i), len(b), len(p), digest(p), zlib.crc32(p[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same = {}
    for r in got:
        assert r.media_bytes > r.payload_bytes // 100 and r.feature.startswith(("image/", "audio/"))
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op2(spark, folders):
    got = registry.QUERIES["op2_neighbours"](spark, folders["edge"]).collect()
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in vectors() if i is not None and v is not None and any(v)]
    for q in (0, 50, 100):
        best: dict = {}
        for i, v in usable:
            for j, w in usable:
                if i == q != j:
                    best[j] = max(best.get(j, -2), float(v @ w / np.sqrt((v @ v) * (w @ w))))
        want = sorted(best, key=lambda j: (-round(best[j], 12), j))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [j for _, j, _ in mine] == want and np.allclose([s for *_, s in mine], [best[j] for j in want], rtol=0, atol=1e-14)


def test_op3(spark, folders):
    got, texts = edge(spark, folders, "op3_simhash")
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t in texts)


def test_op4(spark, folders):
    got, texts = edge(spark, folders, "op4_repeats")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats([(i, t) for i, t in texts], 200))


def test_op5(spark, folders):
    got, texts = edge(spark, folders, "op5_language")
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").encode().split()) + 1) for i, t in texts)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)


def test_op6(spark, folders):
    got, texts = edge(spark, folders, "op6_secrets")
    patterns = (
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 8),
        ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32),
    )
    want = []
    for i, t in texts:
        found = [(m.start(), k, name, m.end()) for k, (name, p, least) in enumerate(patterns) for m in re.finditer(p, t or "") if len(m.group(1)) >= least]
        text = ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found))
        want.append((str(i), *(sum(f[2] == n for f in found) for n, *_ in patterns), digest(text.encode())))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)


def test_op7(spark, folders):
    got = {r.conv_id: r for r in registry.QUERIES["op7_chat"](spark, folders["edge"]).collect()}
    assert set(got) == {1, 2, 3, -7} and got[3].n_turns == 1 and got[3].loss_chars == 0
    said = "".join(f"{r}\n{t}\n" for r, t in (("user", "hi"), ("assistant", ""), ("user", "### x"), ("assistant", "a\\b </turn>")))
    assert got[1].turns_sha256 == got[2].turns_sha256 == digest(said.encode()) and got[1].loss_sha256 == digest(b"a\\b </turn>")


def test_op8(spark, folders):
    got, texts = edge(spark, folders, "op8_toxicity")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op9(spark, folders):
    got, texts = edge(spark, folders, "op9_packing")
    n = check_packing(got, 4096)
    tok = packing.WordEncoder(packing.tokenizer_path()).tokenizer
    want = []
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert n <= -(-sum(r.length for r in got) // 4096) + 2


def test_op10(spark, folders):
    got, texts = edge(spark, folders, "op10_mixing")
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(sum(r.size for r in own), own[0].target)}
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in own)


@pytest.mark.parametrize("toxic", [6, 10])
def test_rare_labels_do_not_stop_the_fit(spark, toxic):
    r = np.random.default_rng(toxic)
    words = [f"w{i}" for i in range(3000)]
    texts = [(i, " ".join(r.choice(words, 12))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()
    assert len(got) == 600 and all(0 <= x.score <= 1 for x in got)


def test_rates_solve_the_dual(spark):
    """At the rates min(cap, exp(lambda z)) a source's words meet its target: the convex dual's gradient is 0."""
    r = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(n)), "ab"[i % 2]) for i, n in enumerate(r.integers(1, 60, 400))]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert abs(sum(x.rate * x.size for x in own) - own[0].target) <= 1e-6 * own[0].target
        free = [(x.size, np.log(x.rate)) for x in own if x.rate < 3 - 1e-9]
        slope = [y / n for n, y in free]
        assert np.ptp(slope) < 1e-9  # one tilt for all documents of the source


def test_pipeline_on_edge_cases(spark, folders):
    docs = common.read(spark, folders["edge"], "documents").select("doc_id", "text", "lang", "source", "n_chars")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, folders["edge"]), f"edge-{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "simhash":
            assert 0 < docs.count() <= n
            fps = [brute_fingerprint(r.text) for r in docs.collect()]
            assert min((a ^ b).bit_count() for i, a in enumerate(fps) for b in fps[:i]) > 4
    check_packing(docs.collect(), 4096)
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    key = lambda df: sorted(map(str, df[cols].itertuples(index=False)))
    assert key(got) == key(want)


def test_vector_queries_on_edge_cases(spark, folders):
    """Null vectors, zero vectors, repeated and null ids; vectors of 8 entries are none of op12's."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folders['edge']}/embeddings.parquet").collect()]
    assert answers(registry.QUERIES["op13_topk"](spark, folders["edge"])) == brute_top(rows, 10, 100)
    assert registry.QUERIES["op12_centroids"](spark, folders["edge"]).count() == 0
    got = registry.QUERIES["op11_whitening"](spark, folders["edge"]).collect()
    whole = [i for i, v in rows if v is not None]
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == sorted(map(str, whole)) and len(got) == 8 * len(whole)
    assert len({r.n for r in got}) == 1 and max(r.identity_error for r in got) < 1e-9
