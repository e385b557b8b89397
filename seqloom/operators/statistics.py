"""Statistics over groups: percentiles by index, histograms, normalisation, null distributions, tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.stats import kde_mass, phi, scott, silverman
from seqloom.operators.dedup import with_row_number


def _ordered(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups, value, n, all, before)``: every different value with its number, its group's, and how many of the group come before it.

    Values are counted, then ordered over range partitions; running sums within a partition start from those of the
    partitions before it.  So a value, or a group, with a third of all rows is no burden.
    """
    from seqloom.plans.stages import Stages

    spark = values.sparkSession
    stages = Stages(spark, "ordered")
    counted = values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stages.cut(counted.repartitionByRange(parts, *groups, value).withColumn("__part", F.spark_partition_id()), "ranged")
    own = ranged.groupBy("__part").agg(F.sum("n").alias("__s"))  # a row for each partition
    offsets = own.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__o"))
    inner = F.sum("n").over(Window.partitionBy("__part").orderBy(*groups, value))
    run = ranged.withColumn("__run", inner).join(F.broadcast(offsets), "__part").withColumn("__run", F.col("__run") + F.col("__o") - F.col("n")).drop("__part", "__o")
    sizes = ranged.groupBy(*groups).agg(F.sum("n").alias("all"))
    first = run.groupBy(*groups).agg(F.min("__run").alias("__first"))
    if not groups:
        both = sizes.crossJoin(F.broadcast(first))
        return run.crossJoin(F.broadcast(both)).withColumn("before", F.col("__run") - F.col("__first")).drop("__run", "__first")
    named = [c for g in groups for c in (F.col(g).alias(f"__{g}"),)]
    both = sizes.select(*named, "all").join(first.select(*[F.col(g).alias(f"___{g}") for g in groups], "__first"), _same([(f"__{g}", f"___{g}") for g in groups])).drop(*[f"___{g}" for g in groups])
    out = run.join(both, _same([(g, f"__{g}") for g in groups]))
    return out.withColumn("before", F.col("__run") - F.col("__first")).drop("__run", "__first", *[f"__{g}" for g in groups])


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of columns: a null group is a group."""
    out = None
    for a, b in pairs:
        one = F.col(a).eqNullSafe(F.col(b))
        out = one if out is None else out & one
    return out


def index_percentiles(values: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``(group, share, value)``: the element at index ``ceil(n p)`` of the sorted values, the last one at most."""
    rows = _ordered(values, [group], value)
    at = lambda p: F.least(F.ceil(F.round(F.col("all") * p, 9)), F.col("all") - 1)
    held = F.filter(F.array(*[F.lit(float(p)) for p in shares]), lambda p: (at(p) >= F.col("before")) & (at(p) < F.col("before") + F.col("n")))
    return rows.select(group, F.explode(held).alias("share"), value)


def quantiles(values: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(groups, q)``: interpolated quantiles of each group, an array in the order of the shares."""
    rows = _ordered(values, groups, value)
    ends = []
    for k, p in enumerate(shares):
        at = F.round((F.col("all") - 1) * F.lit(float(p)), 9)
        ends += [F.struct(F.lit(k).alias("k"), f(at).cast("long").alias("i"), (1 - F.abs(at - f(at))).alias("w"), (F.floor(at) == F.ceil(at)).alias("one")) for f in (F.floor, F.ceil)]
    held = F.filter(F.array(*ends), lambda e: (e["i"] >= F.col("before")) & (e["i"] < F.col("before") + F.col("n")))
    x = rows.select(*groups, F.col(value).cast("double").alias("x"), F.explode(held).alias("e"))
    per = x.groupBy(*groups, F.col("e.k").alias("k")).agg(F.sum(F.col("x") * F.when(F.col("e.one"), 0.5).otherwise(F.col("e.w"))).alias("q"))
    return per.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda e: e["q"]).alias("q"))


def normalised(values: DataFrame, value: str, trim: float = 1.0, by_round: bool = False) -> DataFrame:
    """Adds ``scaled``: min-max scaling to 0..1 with a share of both ends cut off, clamped; null where the range is zero.

    The limits are elements by index: the one at ``ceil(n t) - 1`` (or ``round(n t) - 1``) and its mirror image.
    """
    t = max(trim, 1 - trim)
    rows = _ordered(values.select(value), [], value)
    top = F.round(F.col("all") * t) if by_round else F.ceil(F.col("all") * F.lit(t))
    holds = lambda i: (i > F.col("before")) & (i <= F.col("before") + F.col("n"))
    limits = rows.agg(F.max(F.when(holds(top), F.col(value))).alias("hi"), F.min(F.when(holds(F.col("all") - top + 1), F.col(value))).alias("lo"))
    scaled = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    clamped = F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    return values.crossJoin(F.broadcast(limits)).withColumn("scaled", clamped).drop("hi", "lo")


def histogram(values: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """``(bin, low, high, n)``: equal bins from the least to the greatest value, the last one closed; empty bins are left out."""
    limits = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.when(step > 0, F.floor((F.col(value) - F.col("lo")) / step)).otherwise(0)).cast("int")
    binned = values.where(F.col(value).isNotNull()).crossJoin(F.broadcast(limits)).select(at.alias("bin"), "lo", step.alias("step"))
    return binned.groupBy("bin").agg(F.max(F.col("lo") + F.col("step") * F.col("bin")).alias("low"), F.max(F.col("lo") + F.col("step") * (F.col("bin") + 1)).alias("high"), F.count(F.lit(1)).alias("n"))


def described(values: DataFrame, value: str, *groups: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles (interpolated) and greatest value."""
    out = values.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    q = quantiles(values, list(groups), value, [0.25, 0.5, 0.75])
    if groups:
        named = q.select(*[F.col(g).alias(f"__{g}") for g in groups], "q")
        both = out.join(named, _same([(g, f"__{g}") for g in groups]), "left")
    else:
        both = out.crossJoin(F.broadcast(q))
    return both.select(*groups, "n", "mean", "sd", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "greatest")


def regression(values: DataFrame, x: str, y: str, above: float = 600) -> DataFrame:
    """One row: population moments of ``y``, its line over ``x``, correlation, and how many values lie above a limit."""
    return values.agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"), F.var_pop(y).alias("variance"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count(F.when(F.col(y) > above, 1)).alias("above"),
    )


def running_mean(values: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """``(keys, halved, mean)``: ``m <- (m + x) / 2`` in order, and the plain mean beside it.

    Written as a weighted sum: of n values the i-th weighs ``2^-(n - i + 1)``, the first one as much as the second.
    """
    rows = with_row_number(values.select(*keys, value, *[c for c in dict.fromkeys(order) if c not in (*keys, value)]), "__n", *keys, *order)
    ends = rows.groupBy(*keys).agg(F.min("__n").alias("__first"), F.max("__n").alias("__last"))
    named = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "__first", "__last")
    base = rows.join(named, _same([(k, f"__{k}") for k in keys]))
    n, i = F.col("__last") - F.col("__first") + 1, F.col("__n") - F.col("__first") + 1
    weight = F.pow(F.lit(2.0), -(n - F.greatest(i, F.lit(2)) + 1).cast("double"))
    return base.groupBy(*keys).agg(F.sum(F.when(n == 1, F.col(value)).otherwise(F.col(value) * weight)).alias("halved"), F.avg(value).alias("mean"))


def null_summary(samples: DataFrame, group: str, sample: str, observed: str) -> DataFrame:
    """Per group the observed score, its null's mean and population deviation, their difference and bits."""
    out = samples.groupBy(group).agg(F.max(observed).alias("observed"), F.avg(sample).alias("mean"), F.stddev_pop(sample).alias("sd"), F.count(sample).alias("n"))
    return out.withColumn("delta", F.col("observed") - F.col("mean"))


def kde_pvalues(samples: DataFrame, group: str, sample: str, observed: str) -> DataFrame:
    """``(group, observed, p)``: the mass of the null's Gaussian kernel density between 0 and the observed score, Scott's bandwidth."""
    width = samples.groupBy(group).agg(scott(F.col(sample)).alias("h"), F.max(observed).alias("o"))
    return samples.select(group, sample).join(width, group).groupBy(group).agg(F.max("o").alias("observed"), kde_mass(F.col(sample), F.lit(0.0), F.col("o"), F.col("h")).alias("p"))


def kde_interval(samples: DataFrame, group: str, sample: str, mass: float = 0.95, passes: int = 7, parts: int = 16) -> DataFrame:
    """``(group, h, low, high)``: the central interval of a group's kernel density (Silverman), by search on its distribution.

    A pass cuts each bracket into ``parts`` and weighs all cuts of all groups in one aggregate; without
    spread the interval is the value itself.
    """
    from seqloom.plans.stages import Stages

    stages = Stages(samples.sparkSession, "interval")
    base = samples.groupBy(group).agg(F.coalesce(silverman(F.col(sample)), F.lit(0.0)).alias("h"), F.min(sample).alias("lo"), F.max(sample).alias("hi"))
    tail = (1 - mass) / 2
    sides = F.explode(F.array(F.lit(tail), F.lit(1 - tail))).alias("t")
    ends = base.select(group, "h", sides, (F.col("lo") - 10 * F.col("h")).alias("lo"), (F.col("hi") + 10 * F.col("h")).alias("hi"))
    for _ in range(passes):
        ends = stages.cut(ends, "ends")
        cuts = ends.where("h > 0").withColumn("m", F.explode(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / parts)))
        f = samples.select(group, sample).join(cuts.select(group, "t", "h", "m"), group).groupBy(group, "t", "m").agg(F.avg(phi((F.col("m") - F.col(sample)) / F.col("h"))).alias("f"))
        near = f.groupBy(group, "t").agg(F.max(F.when(F.col("f") < F.col("t"), F.col("m"))).alias("up"), F.min(F.when(F.col("f") >= F.col("t"), F.col("m"))).alias("down"))
        ends = ends.join(near, [group, "t"], "left").select(group, "h", "t", F.coalesce("up", "lo").alias("lo"), F.coalesce("down", "hi").alias("hi"))
    out = ends.groupBy(group).agg(F.max("h").alias("h"), F.max(F.when(F.col("t") < 0.5, F.col("hi"))).alias("low"), F.max(F.when(F.col("t") > 0.5, F.col("hi"))).alias("high"))
    return stages.cut(out, "interval")


def kde_overlap(inner: DataFrame, outer: DataFrame, group: str, score: str, below: float = 0.05) -> DataFrame:
    """``(group, overlap, apart)``: the mass of the outer scores' density within the central 95 % of the inner ones'."""
    inside = kde_interval(inner, group, score).select(group, "low", "high")
    width = outer.groupBy(group).agg(silverman(F.col(score)).alias("h"))
    mass = outer.select(group, score).join(width, group).join(inside, group).groupBy(group).agg(kde_mass(F.col(score), F.col("low"), F.col("high"), F.col("h")).alias("overlap"))
    return mass.withColumn("apart", F.col("overlap") < below)


def one_sample_t(values: DataFrame, group: str, value: str, mean: float = 0.0) -> DataFrame:
    """``(group, n, t, p)``: a two-sided t-test against a mean."""
    out = values.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    t = F.try_divide((F.col("m") - mean) * F.sqrt(F.col("n").cast("double")), F.col("s"))
    return out.select(group, "n", t.alias("t")).withColumn("p", _t_pvalue(F.col("t"), F.col("n") - 1))


@F.pandas_udf(T.DoubleType())
def _t_pvalue(t, df):  # type: ignore[no-untyped-def]
    import pandas as pd

    return pd.Series([None if a != a or b < 1 else t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), by the regularised incomplete beta function."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + term * d, 1e-300) if 1 + term * d > 0 else 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def normality(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, n, k2, p)``: the omnibus test of skewness and kurtosis; null below 20 values."""
    base = values.groupBy(group).agg(F.count(value).alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    z1 = F.asinh(y / F.sqrt(2.0 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - e) / F.sqrt(var)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb * (2.0 / sb + F.sqrt(1 + 4.0 / (sb * sb)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    ok = base.where("n >= 20").select(group, "n", k2.alias("k2"))
    return ok.withColumn("p", F.exp(-F.col("k2") / 2)).unionByName(base.where("n < 20").select(group, "n", F.lit(None).cast("double").alias("k2"), F.lit(None).cast("double").alias("p")))


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    """P(Q <= q) of the studentized range of ``k`` means with ``df`` degrees of freedom, by quadrature."""
    if q <= 0:
        return 0.0
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 8 * z, 8 * wz
    cdf = lambda x: 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def of_range(w: float) -> float:
        return float(min(1.0, k * np.sum(wz * density * (cdf(z) - cdf(z - w)) ** (k - 1))))

    if df > 5000:
        return of_range(q)
    u, wu = np.polynomial.legendre.leggauss(64)
    sd = 1 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - 8 * sd), 1 + 8 * sd
    s, ws = (high - low) / 2 * u + (high + low) / 2, (high - low) / 2 * wu
    log_const = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    dens = np.exp(log_const + (df - 1) * np.log(s) - df * s * s / 2)
    return float(min(1.0, np.sum(ws * dens * np.array([of_range(q * x) for x in s]))))


def tukey_hsd(values: DataFrame, test: str, group: str, value: str, alpha: float = 0.05, against: DataFrame | None = None) -> DataFrame:
    """``(test, group1, group2, diff, p, differs)``: pairwise comparisons of the groups of each test (Tukey and Kramer).

    With ``against`` ``(test, top)`` only those of each test's ``top`` with the others.
    """
    cells = values.groupBy(test, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return tukey_of_cells(cells, test, group, alpha, against)


def tukey_of_cells(cells: DataFrame, test: str, group: str, alpha: float = 0.05, against: DataFrame | None = None) -> DataFrame:
    """As :func:`tukey_hsd`, from each group's number ``n``, mean ``m`` and population variance ``v``."""
    pooled = cells.groupBy(test).agg(
        F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum(F.col("n") * F.col("v")).alias("ss")
    )
    a = cells.select(test, F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("m").alias("m1"))
    b = cells.select(test, F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    se = F.sqrt(F.col("ss") / F.col("df") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    pairs = a.join(b, test).where("group1 < group2")
    if against is not None:
        one = a.join(against.select(test, F.col("top").alias("group1")), [test, "group1"])
        pairs = one.join(b, test).where("group1 <> group2")
    joined = pairs.join(pooled, test).where("df > 0").select(
        test, "group1", "group2", (F.col("m2") - F.col("m1")).alias("diff"), F.try_divide(F.abs(F.col("m2") - F.col("m1")), se).alias("q"), "k", "df"
    )

    @F.pandas_udf(T.DoubleType())
    def p(q, k, df):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series([None if x != x else 1 - studentized_range_cdf(float(x), int(y), float(z)) for x, y, z in zip(q, k, df)], dtype="float64")

    return joined.withColumn("p", p("q", "k", "df")).select(test, "group1", "group2", "diff", "p", (F.col("p") < alpha).alias("differs"))


def shapiro_wilk(x) -> float:
    """Royston's W statistic of a sample of 4 to 5000 values."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(float(m @ m))
    u = 1 / math.sqrt(n)
    a = c.copy()
    a[-1] = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a[0] = -a[-1]
    if n > 5:
        a[-2] = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
        a[1] = -a[-2]
        e = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(e)
    else:
        e = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(e)
    return float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean())))


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p):  # type: ignore[no-untyped-def]
    from statistics import NormalDist

    return p.map(NormalDist().inv_cdf, na_action="ignore")


def shapiro_tests(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, n, w, p)``: Royston's statistic and its p-value, for groups of any size; null below 4 values or without spread.

    Ranks come from range partitions, the rest is sums, so no task holds a group.  The p-value's formula was fitted
    to 4..5000 values.
    """
    rows = with_row_number(values.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("x")), "__n", group, "x")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("__n").alias("first"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    ranked = rows.join(sizes.where("n >= 4 and v > 0"), group).withColumn("i", F.col("__n") - F.col("first") + 1)
    m = ranked.withColumn("m", _normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    edge = lambda k, c: F.max(F.when(F.col("i") == F.col("n") - k, F.col(c)))
    low = lambda k: F.max(F.when(F.col("i") == 1 + k, F.col("x")))
    s = m.groupBy(group).agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), edge(0, "m").alias("m1"), edge(1, "m").alias("m2"),
        edge(0, "x").alias("x1"), edge(1, "x").alias("x2"), low(0).alias("y1"), low(1).alias("y2"), F.max("n").alias("n"), F.max("v").alias("v"),
    )
    n, mm, m1, m2 = F.col("n").cast("double"), F.col("mm"), F.col("m1"), F.col("m2")
    u = 1 / F.sqrt(n)
    poly = lambda *c: sum((F.lit(x) * F.pow(u, F.lit(k + 1)) for k, x in enumerate(c)), F.lit(0.0))
    a1 = m1 / F.sqrt(mm) + poly(0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
    a2 = m2 / F.sqrt(mm) + poly(0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    ends1, ends2 = F.col("x1") - F.col("y1"), F.col("x2") - F.col("y2")
    wide = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    narrow = (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)
    many = a1 * ends1 + a2 * ends2 + (F.col("mx") - m1 * ends1 - m2 * ends2) / F.sqrt(wide)
    few = a1 * ends1 + (F.col("mx") - m1 * ends1) / F.sqrt(narrow)
    top = F.when(n > 5, many).otherwise(few)
    w = F.least(F.lit(1.0), top * top / (n * F.col("v")))
    ln, lw = F.log(n), F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    z = F.when(
        n > 11, (lw - (0.0038915 * ln * ln * ln - 0.083751 * ln * ln - 0.31082 * ln - 1.5861)) / F.exp(0.0030302 * ln * ln - 0.082676 * ln - 0.4803)
    ).otherwise((-F.log(0.459 * n - 2.273 - lw) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n)) / F.exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n))
    tested = s.withColumn("w", w).select(group, "w", (1 - phi(z)).alias("p"))
    return sizes.join(tested, group, "left").select(group, "n", "w", "p")


def subset_t(values: DataFrame, value: str, key: str, size: int = 1000, subsets: int = 3, mean: float = 0.0, seed: int = 1) -> DataFrame:
    """``(subset, n, t, p)``: the t-test repeated on seeded random subsets of ``size`` values, each without replacement.

    A subset is the values of smallest hash, numbered over range partitions.
    """
    out = None
    for k in range(subsets):
        mixed = values.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.col(key).alias("key"))
        one = mixed.orderBy("h", "key").limit(size).select(F.lit(k).alias("subset"), "x")
        out = one if out is None else out.unionByName(one)
    return one_sample_t(out, "subset", "x", mean)


def cumulative(values: DataFrame, value: str, order: str) -> DataFrame:
    """Adds ``share`` and ``cumulative``: proportional probabilities and their running sum in a total order.

    Sums run within range partitions, from the sum of those before them.
    """
    from seqloom.plans.stages import Stages

    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stages = Stages(spark, "cumulative")
    ranged = stages.cut(values.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")
    own = ranged.groupBy("__part").agg(F.sum(value).alias("s"))
    w = Window.orderBy("__part")
    offsets = own.select("__part", (F.sum("s").over(w) - F.col("s")).alias("__before"), F.sum("s").over(Window.partitionBy()).alias("__all"))
    inner = Window.partitionBy("__part").orderBy(order)
    run = ranged.withColumn("__run", F.sum(value).over(inner)).join(F.broadcast(offsets), "__part")
    return run.withColumn("share", F.col(value) / F.col("__all")).withColumn("cumulative", (F.col("__before") + F.col("__run")) / F.col("__all")).drop("__part", "__run", "__before", "__all")


def picked(cumulated: DataFrame, draws: DataFrame, key: str, draw: str = "u") -> DataFrame:
    """Each draw in 0..1 with the first record whose cumulative probability is above it, by a range join on buckets.

    There are about as many buckets as records, so a bucket meets few.  The last record's range is closed: no draw is lost.
    """
    kept = cumulated.where("share > 0")
    n = kept.agg(F.count(F.lit(1)).alias("n"), F.max("cumulative").alias("top")).head()
    buckets = max(1, min(n["n"], 2**30))
    top = F.col("cumulative") == F.lit(n["top"])
    spread = kept.select(key, (F.col("cumulative") - F.col("share")).alias("lo"), F.when(top, F.lit(float("inf"))).otherwise(F.col("cumulative")).alias("hi"))
    at = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.least(c, F.lit(1.0)) * buckets).cast("int"), F.lit(buckets - 1)))
    spread = spread.withColumn("bucket", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    asked = draws.withColumn("bucket", at(F.col(draw)))
    return asked.join(spread, "bucket").where((F.col(draw) >= F.col("lo")) & (F.col(draw) < F.col("hi"))).drop("bucket", "lo", "hi")
