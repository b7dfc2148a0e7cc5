"""Roles of columns, finite policy, weights, and checks of the data in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

PARTITION_ROWS = 8192  # counted rows to a partition, about


@dataclass(frozen=True)
class Roles:
    """Predictors by variable name, response, optional sigma, mask (rows kept), order and group keys."""

    x: dict
    y: str
    sigma: str | None = None
    mask: str | None = None
    order: str | None = None
    keys: tuple = ()

    @classmethod
    def of(cls, x, y: str, variables: tuple = ("x",), **more) -> Roles:
        cols = [x] if isinstance(x, str) else list(x)
        return cls(dict(zip(variables, cols)) if not isinstance(x, dict) else x, y, **more)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def points(df: DataFrame, roles: Roles, policy: str = "raise", extra: tuple = ()) -> DataFrame:
    """Keys, predictors (by variable), y, w (1 / sigma) and ord as doubles.

    policy: raise (checked by an aggregate), omit (rows with a null, NaN or infinite role go),
    propagate (nothing is checked), mean (bad values become the mean of the finite ones).
    """
    if roles.mask:
        df = df.filter(F.col(roles.mask))
    cols = {f"v_{v}": F.col(c).cast("double") for v, c in roles.x.items()} | {"y": F.col(roles.y).cast("double")}
    s = F.col(roles.sigma).cast("double") if roles.sigma else None
    order = F.col(roles.order) if roles.order else next(iter(cols.values()))
    checked = [*cols.values(), *([s] if s is not None else [])]
    ok = finite(checked[0])
    for c in checked[1:]:
        ok &= finite(c)
    if policy == "raise":
        n = df.agg(F.count(F.when(~ok, 1)).alias("bad"), F.count(F.when(~(s > 0), 1) if s is not None else F.lit(None)).alias("sigma")).first()
        if n.bad:
            raise ValueError(f"{n.bad} rows hold null, NaN or infinite values")
        if n.sigma:
            raise ValueError(f"{n.sigma} rows have a sigma that is not positive")
    elif policy == "omit":
        df = df.filter(ok)
    elif policy == "mean":
        cols = replaced_by_mean(df, cols)
    w = F.lit(1.0) if s is None else 1.0 / s
    return df.select(*roles.keys, *extra, *(c.alias(v) for v, c in cols.items()), w.alias("w"), order.alias("ord"))


def variety(pts: DataFrame, *columns: list) -> tuple:
    """The number of rows, and about how many differ in each list of columns, in one pass."""
    return tuple(pts.agg(F.count("*"), *(F.approx_count_distinct(F.xxhash64(*c)) for c in columns)).first())


def repeated(pts: DataFrame, seen: tuple | None = None) -> DataFrame:
    """Rows that agree in all columns once, with their number `_m`, where that leaves at most a quarter of the rows; else
    every row, with 1. Sums over rows, weighted by `_m`, are the same. Takes one pass to count and one to group; 0 and
    -0 agree, as in any grouping. Rows that are counted lie in as few partitions as they need, since every later sum
    has a task for each, however many the grouping took. seen: variety() of all columns, if it is known."""
    if "_m" in pts.columns:
        return pts
    n, distinct = seen or variety(pts, pts.columns)
    if n and 4 * distinct <= n:
        most = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return pts.groupBy(*pts.columns).agg(F.count("*").cast("double").alias("_m")).repartition(min(most, -(-distinct // PARTITION_ROWS)))
    return pts.withColumn("_m", F.lit(1.0))


def replaced_by_mean(df: DataFrame, cols: dict) -> dict:
    means = df.agg(*(F.avg(F.when(finite(c), c)).alias(v) for v, c in cols.items())).first()
    return {v: F.when(finite(c), c).otherwise(F.lit(means[v])) for v, c in cols.items()}


def curve(pts: DataFrame, variable: str = "x") -> DataFrame:
    """x, y, ord of points(), for starting rules."""
    return pts.select(F.col(f"v_{variable}").alias("x"), "y", "ord")


def describe(df: DataFrame, columns: list) -> DataFrame:
    """A row per column: count, finite, min, max, mean, population deviation, distinct."""
    ok = {c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n"), F.count(v).alias("n_finite"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_distinct(v).alias("n_distinct"),
        )
        for c, v in ok.items()
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def quantiles(df: DataFrame, value: Column, shares: list, collect: int = 10_000) -> list:
    """Exact interpolated quantiles of the finite values, by histograms that close in on the ranks they need: each
    pass counts 1,024 cells of every interval that holds a rank, all in one aggregate, and keeps those cells, until
    each holds one value or at most `collect` rows, which are fetched. No task orders or keeps all distinct values.
    """
    rows = df.select(value.cast("double").alias("v")).filter(finite(F.col("v")))
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({min(n - 1, int((n - 1) * q) + i) for q in shares for i in (0, 1)})
    held, known = {r: (lo, hi, 0, n) for r in ranks}, {}  # rank -> interval, rows before it, rows in it
    v = F.col("v")
    while held:
        known |= {r: a for r, (a, b, *_) in held.items() if a == b}
        held = {r: x for r, x in held.items() if r not in known}
        open_ = sorted({x for x in held.values() if x[3] > collect})
        if open_:
            which = cell = F.lit(None).cast("int")
            for i, (a, b, *_) in enumerate(open_):  # disjoint, at most one for each rank
                inside = (v >= a) & (v <= b)
                which, cell = F.when(inside, F.lit(i)).otherwise(which), F.when(inside, F.least(F.floor((v - a) / ((b - a) / 1024)), F.lit(1023)).cast("int")).otherwise(cell)
            cells = rows.groupBy(which.alias("i"), cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).filter("i is not null").collect()
            for i, (a, b, before, _) in enumerate(open_):
                at = before
                for c in sorted((c for c in cells if c.i == i), key=lambda c: c.a):
                    for r in [r for r, x in held.items() if x == (a, b, before, _) and at <= r < at + c.n]:
                        if (c.a, c.b) == (a, b):  # cells can't be told apart any more
                            known[r] = a
                        else:
                            held[r] = (c.a, c.b, at, c.n)
                    at += c.n
            continue
        few = sorted(set(held.values()))
        if few:
            some = F.lit(False)
            for a, b, *_ in few:
                some = some | ((v >= a) & (v <= b))
            values = sorted(x.v for x in rows.filter(some).collect())  # at most `collect` for each rank
            for a, b, before, inside in few:
                own = [x for x in values if a <= x <= b]
                known |= {r: own[r - before] for r, x in held.items() if x == (a, b, before, inside)}
        break
    out = []
    for q in shares:
        h = (n - 1) * q
        low, high = known[int(h)], known[min(n - 1, int(h) + 1)]
        out.append(low + (high - low) * (h - int(h)))
    return out


def ranked_rows(df: DataFrame, order: list) -> DataFrame:
    """df with `_rank` (from 0) by `order`: rows are numbered inside range partitions, and each partition from the
    sum of the counts before it (a row per partition). The numbered rows are written once to the shared folder."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_id", 33)
    total, bases = 0, []
    for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        bases.append((r.p, total))
        total += r.n
    table = df.sparkSession.createDataFrame(bases, "_p long, _base long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(table), part == F.col("_p")).withColumn("_rank", F.col("_base") + place).drop("_id", "_p", "_base")


def lagged(df: DataFrame, order: list, columns: list, lags: int, keys: tuple = (), block: int = 100_000, leads: int = 0) -> DataFrame:
    """df with <column>_1 ... <column>_<lags>, of the rows before it by `order` within its keys (null where there are
    none), and `_t`, how many of those there are; with leads, also <column>_next1 ..., of the rows after it.

    Rows are ranked by range partitions and cut into blocks of `block` ranks; the last rows of a block also go to
    the next one, as its halo. So each window holds a block, and one long series needs no task of its own."""
    ranks = ranked_rows(df, [*(F.col(k) for k in keys), *order])
    own = F.floor(F.col("_rank") / block)
    place = F.col("_rank") % block
    near = F.array_compact(F.array(own, F.when(place >= block - lags, own + 1), F.when(place < leads, own - 1)))
    rows = ranks.withColumn("_block", F.explode(near))
    w = W.partitionBy("_block").orderBy("_rank")
    back = lambda c, i: F.lag(c, i).over(w)
    for i in range(1, lags + 1):
        same = back("_rank", i).isNotNull()
        for k in keys:
            same = same & back(F.col(k), i).eqNullSafe(F.col(k))
        rows = rows.withColumn(f"_same{i}", same)
    rows = rows.select("*", *(F.when(F.col(f"_same{i}"), back(c, i)).alias(f"{c}_{i}") for c in columns for i in range(1, lags + 1)))
    ahead = lambda c, i: F.lead(c, i).over(w)
    for i in range(1, leads + 1):
        same = ahead("_rank", i).isNotNull()
        for k in keys:
            same = same & ahead(F.col(k), i).eqNullSafe(F.col(k))
        rows = rows.select("*", *(F.when(same, ahead(c, i)).alias(f"{c}_next{i}") for c in columns))
    seen = sum((F.col(f"_same{i}").cast("int") for i in range(1, lags + 1)), F.lit(0))
    return rows.filter(F.col("_block") == own).withColumn("_t", seen).drop("_block", "_rank", *(f"_same{i}" for i in range(1, lags + 1)))


def turning_points(df: DataFrame, centre: float = 0.0, block: int = 100_000) -> DataFrame:
    """models.turns for series of any length: x, y - centre, peak and crossing of each row of x, y and ord, over blocks of
    ranks that see the row before and the row after them."""
    c = df.select("x", "ord", (F.col("y") - centre).alias("y"))
    t = lagged(c, [F.col("x"), F.col("ord")], ["x", "y"], 1, block=block, leads=1)
    y, a = F.col("y"), F.abs("y")
    peak = (a > F.abs("y_1")) & (a > F.abs("y_next1"))
    cross = F.when(y * F.col("y_next1") < 0, F.col("x") - y * (F.col("x_next1") - F.col("x")) / (F.col("y_next1") - y))
    return t.select("x", "y", F.coalesce(peak, F.lit(False)).alias("peak"), cross.alias("crossing"))


def iqr_outliers(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr]; exact interpolated quartiles."""
    q1, q3 = quantiles(df, F.col(column), [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    iqr = q3 - q1
    return df.filter((F.col(column) < q1 - k * iqr) | (F.col(column) > q3 + k * iqr))


def mad_outliers(df: DataFrame, column: str, k: float = 5.0) -> DataFrame:
    """Rows further than k robust deviations (1.4826 MAD) from the median; none if that is 0."""
    (m,) = quantiles(df, F.col(column), [0.5])
    if m is None:
        return df.limit(0)
    s = 1.4826 * quantiles(df, F.abs(F.col(column) - m), [0.5])[0]
    return df.filter(F.abs(F.col(column) - m) > k * s) if s > 2.3e-16 else df.limit(0)


def duplicates(df: DataFrame, column: str) -> int:
    r = df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("d")).first()
    return r.n - r.d


def collinear(df: DataFrame, columns: list, limit: float = 0.95) -> DataFrame:
    """a, b, r for pairs of columns correlated beyond limit."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stats = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s")).filter(F.abs("r") > limit)


def validate(df: DataFrame, roles: Roles, min_points: int = 2) -> dict:
    """errors and warnings about size, ranges, constants, duplicates and sigma, from one aggregate."""
    cols = {**roles.x, "response": roles.y}
    agg = [F.count("*").alias("n")]
    for v, c in cols.items():
        d = F.col(c).cast("double")
        f = F.when(finite(d), d)
        agg += [F.min(f).alias(f"{v}_lo"), F.max(f).alias(f"{v}_hi"), F.count(F.when(~finite(d), 1)).alias(f"{v}_bad"), F.count_distinct(f).alias(f"{v}_distinct"), F.count(f).alias(f"{v}_n")]
    if roles.sigma:
        s = F.col(roles.sigma).cast("double")
        agg.append(F.count(F.when(~(finite(s) & (s > 0)), 1)).alias("sigma_bad"))
    r = df.agg(*agg).first().asDict()
    errors, warnings = [], []
    if r["n"] < min_points:
        errors.append(f"{r['n']} rows, at least {min_points} are needed")
    for v, c in cols.items():
        if r[f"{v}_bad"]:
            errors.append(f"{c}: {r[f'{v}_bad']} values are null, NaN or infinite")
        if r[f"{v}_lo"] is None:
            continue
        span = r[f"{v}_hi"] - r[f"{v}_lo"]
        if span == 0:
            (warnings if v == "response" else errors).append(f"{c} is constant")
        elif v != "response" and span < 1e-10:
            warnings.append(f"{c}: tiny range {span:g}")
        elif v != "response" and span > 1e10:
            warnings.append(f"{c}: huge range {span:g}")
        if v != "response" and r[f"{v}_n"] > r[f"{v}_distinct"]:
            warnings.append(f"{c}: {r[f'{v}_n'] - r[f'{v}_distinct']} repeated values")
    if r.get("sigma_bad"):
        errors.append(f"{roles.sigma}: {r['sigma_bad']} values are not positive")
    return {"errors": errors, "warnings": warnings, **r}
