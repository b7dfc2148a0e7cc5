"""The operators' queries, queries for those of their columns that SQL can express, and that SQL."""

from pyspark.sql import functions as F

from . import language, media, mixing, secrets
from .common import read
from .chat import op7_chat
from .exponion import op12_centroids
from .language import op5_language
from .media import op1_media
from .mixing import op10_mixing
from .neighbours import op2_neighbours
from .packing import op9_packing
from .pivots import op13_topk
from .repeats import op4_repeats
from .secrets import op6_secrets
from .simhash import op3_simhash
from .toxicity import op8_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_media": op1_media,
    "op2_neighbours": op2_neighbours,
    "op3_simhash": op3_simhash,
    "op4_repeats": op4_repeats,
    "op5_language": op5_language,
    "op6_secrets": op6_secrets,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_topk": op13_topk,
}


def media_payload(spark, sf_dir):
    """op1's columns that don't depend on the stored form."""
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def language_base(spark, sf_dir):
    """op5's columns that don't depend on the network."""
    docs = read(spark, sf_dir, "documents")
    out = language.score_documents(docs, rounds=0)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secrets_base(spark, sf_dir):
    """op6's columns that don't depend on the network."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), None, ("doc_id",))).drop("spans")


def mixing_targets(spark, sf_dir):
    """op10's columns that don't depend on the rates."""
    return mixing.op10_mixing(spark, sf_dir).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


def whitening_deviations(spark, sf_dir):
    """op11's columns that need no eigenvector, a row per vector."""
    return op11_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


QUERIES |= {"whitening_deviations": whitening_deviations, "media_payload": media_payload, "language_base": language_base, "secrets_base": secrets_base, "mixing_targets": mixing_targets}

#: CRC-32 of a list of bytes: its table by the polynomial, then a fold.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)))"
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295)"
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _found(kind: str, pattern: str, keep: str) -> str:
    """Rows of matches of one kind: their code points come from the lengths of what lies between them."""
    return rf"""SELECT doc_id, n, '{kind}' AS kind, {"assign access hex".split().index(kind)} AS o, s, s + length(m) AS e FROM (
  SELECT doc_id, n, m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s FROM (
  SELECT doc_id, n, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, n, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM docs))) WHERE {keep}"""


_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_EIGHT = r"""length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""
#: Vectors of finite numbers.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def _kmeans(clusters: int = 8, rounds: int = 10, step: int = 1024, seed: int = 3) -> str:
    """A pair of common table expressions per round: whose each vector is, and the floors of means."""
    near = "SELECT i, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, j := j)) AS m FROM v, c{r} GROUP BY i"
    mean = "SELECT j, list(floor_sum ORDER BY pos) AS c FROM (SELECT m.j AS j, pos, (sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{r} JOIN v ON a{r}.i = v.i, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY j"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: floor({step} * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for r in range(rounds):
        parts += [f"a{r} AS MATERIALIZED ({near.format(r=r)})", f"n{r} AS MATERIALIZED ({mean.format(r=r)})", f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN n{r} n ON c.j = n.j)"]
    return f"""WITH {", ".join(parts)}, a AS (SELECT i, m FROM ({near.format(r=rounds)}))
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN v ON a.i = v.i JOIN c{rounds} k ON k.j = m.j"""


ORACLE = {
    "whitening_deviations": f"""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x FROM embeddings WHERE {_FINITE}),
 f AS (SELECT DISTINCT x FROM r), s AS (SELECT pos, sum(x[pos]) AS s, count(*) AS n FROM f, range(1, 65) t(pos) GROUP BY pos), l AS (SELECT list(s ORDER BY pos) AS s, any_value(n) AS n FROM s)
SELECT vec_id, n, list_sum(list_transform(list_zip(x, s), lambda p: ((n * p[1] - p[2]) * (n * p[1] - p[2]))::BIGINT))::BIGINT AS deviation FROM r, l""",
    "op12_centroids": _kmeans(),
    "op13_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings WHERE {_FINITE}),
 p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
QUALIFY rank <= 10""",
    "media_payload": f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 p AS (SELECT doc_id, octet_length(b) AS n, b || repeat('\\x00'::BLOB, CASE WHEN octet_length(b) = 0 THEN 64 ELSE ((64 - octet_length(b) % 64) % 64) END::BIGINT) AS b FROM d),
 q AS (SELECT doc_id, n, octet_length(b) AS m, sha256(b) AS h, right(hex(b), 128) AS tail FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, lower(h) AS payload_sha256,
 {_CRC.format(bytes="list_transform(range(64), lambda i: ('0x' || substr(tail, (2 * i + 1)::INTEGER, 2))::BIGINT)")} AS tail_crc32 FROM q, crc""",
    "language_base": f"""
WITH {_CRC_TABLE}, w AS (SELECT doc_id, {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 10 = 0 AS held_out,
  list_append({_WORDS.replace("text", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, chr(10)) AS ws FROM documents, crc),
 t AS (SELECT doc_id, held_out, unnest(ws) AS word FROM w), c AS (SELECT word, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.n) AS n_known, any_value(s.n)::BIGINT AS train_tokens,
 round(sum(log10((coalesce(c.n, 0) + 0.1::DOUBLE) / (s.n + 0.1::DOUBLE * (s.v + 1)))), 4) AS base_score FROM t LEFT JOIN c ON t.word = c.word, s GROUP BY doc_id, held_out""",
    "secrets_base": rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents), found AS (
  {_found("assign", _ASSIGN_SQL, _EIGHT)} UNION ALL {_found("access", "AKIA[A-Z0-9]+", "length(m) >= 16")} UNION ALL {_found("hex", "[0-9a-f]+", "length(m) >= 32")})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o), '')) AS base_sha256 FROM docs d LEFT JOIN found f ON d.n = f.n GROUP BY d.doc_id, d.n""",
    "mixing_targets": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
 it(i, source, source_size, w, fixed, target) AS (SELECT 0, source, source_size, w, false, 0.0::DOUBLE FROM s
  UNION ALL SELECT i + 1, source, source_size, w, fixed OR share > 3 * source_size, CASE WHEN fixed OR share > 3 * source_size THEN 3.0 * source_size ELSE share END FROM (
  SELECT *, (sum(source_size) OVER () - sum(CASE WHEN fixed THEN 3.0 * source_size ELSE 0 END) OVER ()) * w / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (), 0) AS share FROM it WHERE i < 30))
SELECT d.doc_id, d.source, d.size, it.source_size, round(it.target, 3) AS target FROM d JOIN it ON it.i = 30 AND it.source IS NOT DISTINCT FROM d.source""",
    "op7_chat": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(regexp_replace(role, '(\\|### |</turn>|: )', '#\1', 'g')) + length(regexp_replace(text, '(\\|### |</turn>)', '#\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
