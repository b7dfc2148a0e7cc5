"""Small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, copies long, key string, s long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6))) for _ in range(n))


def rows(seed=0, n=60):
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " \t\n", "x", "é ü 한국어 “q”. it's", texts[3], texts[3], words(r, 9000)]
    near = texts[5].split()
    texts += [" ".join([*near[:-1], "changed"]), texts[5].upper(), texts[7] + " " + texts[8], "a" * 700, "ab" * 400]
    out = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), 1, 0.5, 2, "k", 3) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[9], None, "s0", None, None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
