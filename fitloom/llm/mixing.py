"""Entropy balancing of sources to target weights.

A source's documents get rates r_i = min(cap, exp(lambda_s * z_i)), z_i = size_i / mean size of the
source: the rates closest in relative entropy to 1 for which the source's tokens meet its target.
lambda is the root of the convex dual's gradient; all sources take a safeguarded Newton step together
in one aggregate a round, over (source, size, count) classes rather than documents. Rates are rounded
into whole copies by systematic rounding along sizes, then repairs change copies by one: of many
documents where a source is far from its target, then of single ones whose size is nearest to what it
still lacks.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, last in order.
Repeated rows are mixed each on its own; documents of one size (ties) share a rate and take their copies in
the order of their ids, then of a hash of their texts, then of rows that are equal in both. A very long text is one size among others, at most `cap` times its own. An empty
table gives no rows. Columns besides id, text and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, WORD, given_back, numbered, read, set_aside, stage

CAP = 3.0
SALTS, RUN = 16, 1 << 20
REPAIRS = 4
NEAR = 0.01
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size (the number of words of the whole text), a hash of the text and the columns `more`."""
    return docs.select("doc_id", "source", *more, F.xxhash64("text").alias(TEXT), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: dict, weights: dict, cap: float = CAP) -> dict:
    """Share the total by weight; what exceeds cap times a source's size is shared again among the rest."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            out.update({s: left * weights[s] / total for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


FEW = 100_000  # sources whose table, some 10 MB at most, is sent to every task; more are joined by a shuffle


def by_source(spark, rows: list, fields: str) -> DataFrame:
    """A table of one row per source, or per source and size, made on the driver; `few` tells whether it may be broadcast."""
    table = spark.createDataFrame(rows, f"source string, {fields}")
    table.few = len(rows) <= FEW
    return table


def sent(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def on_source(df: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table of by_source()."""
    few = table.few
    return df.join(sent(table.withColumnRenamed("source", "_s"), few), same("source", "_s")).drop("_s")


def solve(classes: DataFrame, want: dict, size: dict, mean: dict, cap: float, rounds: int = 60, tol: float = 1e-9) -> dict:
    """lambda of every source. Newton within a bracket that each round narrows."""
    spark = classes.sparkSession
    lam, low, high = dict.fromkeys(want, 0.0), {}, {}
    todo = {s for s in want if size[s] > 0 and want[s] < cap * size[s] * (1 - 1e-12)}
    out = {s: (float("inf") if s not in todo else 0.0) for s in want}
    for _ in range(rounds):
        if not todo:
            break
        table = by_source(spark, [(s, lam[s], mean[s]) for s in todo], "lam double, mean double")
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        bounded = F.least(rate, F.lit(cap))
        got = on_source(classes, table).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * bounded).alias("f"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("d"),
        )
        for s, f, d in got.collect():  # a row per source
            gap = f - want[s]
            out[s] = lam[s]
            if abs(gap) <= tol * max(want[s], 1.0):
                todo.discard(s)
                continue
            if gap > 0:
                high[s] = min(high.get(s, lam[s]), lam[s])
            else:
                low[s] = max(low.get(s, lam[s]), lam[s])
            new = lam[s] - gap / d if d > 0 else None
            if s in low and s in high:
                if new is None or not low[s] < new < high[s]:
                    new = (low[s] + high[s]) / 2
                if high[s] - low[s] <= 1e-14 * max(1.0, abs(low[s])):
                    todo.discard(s)
            elif new is None or abs(new - lam[s]) > 4 + 2 * abs(lam[s]):
                new = lam[s] + (4 + abs(lam[s])) * (-1 if gap > 0 else 1)
            lam[s] = new
    return out


TEXT = "_text"


def salted(rows: DataFrame) -> DataFrame:
    """Deal the documents of one source and size out by id and text: in SALTS parts, or in more where these would hold
    over RUN rows. Parts that still hold more than twice as many, rows that are equal in both, are dealt by row."""
    salts = F.lit(SALTS)
    many = rows.groupBy("source", "size").agg(F.count("*").alias("n")).filter(F.col("n") > SALTS * RUN).collect()  # rows / (SALTS x RUN) at most
    if many:
        table = by_source(rows.sparkSession, [(r.source, r.size, -(-r.n // RUN)) for r in many], "_z long, _n long")
        rows = rows.join(sent(table.withColumnRenamed("source", "_s"), table.few), same("source", "_s") & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")
        salts = F.coalesce("_n", F.lit(SALTS))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", TEXT), salts).cast("long")).drop("_n")
    equal = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * RUN).collect()  # rows / (2 x RUN) at most
    if equal:
        table = rows.sparkSession.createDataFrame([(r.source, r.size, r.salt, -(-r.n // RUN)) for r in equal], "_s string, _z long, _t long, _n long")
        rows = rows.join(sent(table, len(equal) <= FEW), same("source", "_s") & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t")), "left")
        part = F.shiftleft(F.pmod(F.xxhash64(ROW), F.coalesce("_n", F.lit(1))), 32)
        rows = rows.withColumn("salt", F.col("salt") + part).drop("_s", "_z", "_t", "_n")
    return rows


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for every row of docs."""
    return assign(numbered(sized(docs), "mix-sizes"), weights, cap).drop(ROW)


def assign(rows: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """mix() for rows of sized() with ROW (other columns are kept) read from a written table."""
    spark = rows.sparkSession
    rows = salted(rows)
    classes = stage(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-classes")
    per = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("t"), F.sum("n").alias("n")).collect()
    # bytes order is code point order; null comes last
    per = sorted(per, key=lambda r: (r.source is None, (r.source or "").encode()))
    size = {r.source: int(r.t) for r in per}
    mean = {r.source: max(1e-9, r.t / r.n) for r in per}
    weight = {r.source: weights[i % len(weights)] for i, r in enumerate(per)}
    want = targets(size, weight, cap)
    lam = solve(classes, want, size, mean, cap)
    table = by_source(
        spark,
        [(s, size[s], want[s], min(lam[s], 1e300), mean[s]) for s in want],
        "source_size long, target double, lam double, mean double",
    )
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lam") * (F.col("size") / F.col("mean")), F.lit(700.0))))
    )
    top = F.floor(F.lit(cap))
    # expected copies before each class, along falling sizes; classes, not documents, go through the window
    run = W.partitionBy("source").orderBy(F.desc("size"), "salt").rowsBetween(W.unboundedPreceding, -1)
    edges = on_source(classes, table).withColumn("rate", rate).withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0)))
    edges = stage(edges.select("source", "size", "salt", "rate", "before", "source_size", "target"), "mix-edges")
    rank = W.partitionBy("source", "size", "salt").orderBy("doc_id", TEXT, ROW)
    ranked = rows.withColumn("k", F.row_number().over(rank))
    e = edges.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_t"), "rate", "before", "source_size", "target")
    placed = ranked.join(e, same("source", "_s") & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t")))
    at = lambda k: F.floor(F.col("before") + k * F.col("rate") + F.lit(0.5))
    copies = F.least(top, at(F.col("k")) - at(F.col("k") - 1)).cast("long")
    out = placed.drop("_s", "_z", "_t").withColumn("copies", copies)
    return repair(stage(out, "mix-copies"), want, int(cap), REPAIRS).drop("salt", "k", "before", TEXT).withColumn("taken", F.col("copies") * F.col("size"))


def lacking(rows: DataFrame, want: dict) -> dict:
    got = {r.source: r.t for r in rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    return {s: want[s] - got.get(s, 0) for s in want}


def in_bulk(rows: DataFrame, lack: dict, cap: int) -> DataFrame:
    """Give or take one copy of as many documents, the largest that fit first, as fill what each source lacks."""
    table = by_source(rows.sparkSession, [(s, float(x)) for s, x in lack.items()], "lack double")
    room = F.when(F.col("lack") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    able = on_source(rows, table).filter(room & (F.col("size") > 0) & (F.col("size") <= F.abs("lack"))).select("source", "size", "salt", "k", "lack")
    run = W.partitionBy("source").orderBy(F.desc("size"), "salt").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0))
    few = able.groupBy("source", "size", "salt").agg(F.count("*").alias("n"), F.first("lack").alias("lack"))
    few = few.withColumn("m", F.least("n", F.floor((F.abs("lack") - before) / F.col("size")))).filter("m > 0")
    few = few.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_t"), "m")
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("k"))
    cell = lambda: same("source", "_s") & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t"))
    step = able.withColumn("r", rank).join(few, cell()).filter("r <= m")
    step = step.select("_s", "_z", "_t", F.col("k").alias("_k"), F.signum("lack").cast("long").alias("_c"))
    return rows.join(step, cell() & (F.col("k") == F.col("_k")), "left").withColumn("copies", F.col("copies") + F.coalesce("_c", F.lit(0))).drop("_s", "_z", "_t", "_k", "_c")


def repair(rows: DataFrame, want: dict, cap: int, rounds: int) -> DataFrame:
    """Bring each source nearer to its target.

    Rounding errs by half the longest document at most. Where that is over NEAR of the target, which takes
    a small source with a very long document, copies of many documents are changed at once. Then, per
    source and round, the one document whose size best fills what is missing gains or loses a copy.
    """
    spark = rows.sparkSession
    changed: dict = {}
    lack = lacking(rows, want)
    for _ in range(cap):
        far = {s: x for s, x in lack.items() if abs(x) > NEAR * want[s] and abs(x) >= 1}
        if not far:
            break
        new = stage(in_bulk(rows, far, cap), "mix-copies")
        less = lacking(new, want)
        if less == lack:
            break
        rows, lack = new, less
    one = ["doc_id", "size", "salt", "k"]
    for _ in range(rounds):
        todo = {s: x for s, x in lack.items() if abs(x) >= 1}
        if not todo:
            break
        table = by_source(spark, [(s, float(x)) for s, x in todo.items()], "lack double")
        room = F.when(F.col("lack") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        used = apply(rows, changed)
        best = (
            on_source(used, table)
            .filter(room & (F.col("size") > 0))
            .groupBy("source")
            .agg(F.min(F.struct(F.abs(F.abs("lack") - F.col("size")).alias("off"), *one)).alias("b"))
        )
        moved = False
        for s, b in best.collect():  # a row per source
            if b.off < abs(lack[s]):
                step = 1 if lack[s] > 0 else -1
                key = (s, b.doc_id, b.size, b.salt, b.k)
                changed[key] = changed.get(key, 0) + step
                lack[s] -= step * b.size
                moved = True
        if not moved:
            break
    return apply(rows, changed)


def apply(rows: DataFrame, changed: dict) -> DataFrame:
    """Add the changes, at most REPAIRS per source."""
    if not changed:
        return rows
    kinds = dict(rows.dtypes)
    schema = f"_s string, _d {kinds['doc_id']}, _z long, _t {kinds['salt']}, _k int, _c long"
    table = rows.sparkSession.createDataFrame([(*key, c) for key, c in changed.items()], schema)
    on = same("source", "_s") & same("doc_id", "_d") & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t")) & (F.col("k") == F.col("_k"))
    return rows.join(sent(table, len(changed) <= FEW), on, "left").withColumn("copies", F.col("copies") + F.coalesce("_c", F.lit(0))).drop("_s", "_d", "_z", "_t", "_k", "_c")


def op10_mixing(spark, sf_dir) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast(T.LongType()).alias("taken"), "source", "copies")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say.

    Rows are told apart by a number of their own, so equal rows and rows without an id are copied each on
    its own; columns may have any names. Null and empty texts have size 0 and go; one very long text is at most `cap` times its size.
    """
    rows, view = set_aside(docs, "mix-rows", ("doc_id", "source", "text"))
    sizes = stage(sized(view, ROW), "mix-sizes")
    copies = assign(sizes, weights, cap).filter("copies > 0").select(ROW, F.col("copies").alias("_n"))
    out = rows.join(copies, ROW)
    return given_back(out.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))), docs.columns)
