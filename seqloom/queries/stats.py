"""Statistics of scores and null distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.stats import bit_score, phi_sql, reflected
from seqloom.operators import statistics as st
from seqloom.queries.registry import query, table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
s AS (SELECT * FROM r, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) v(share)) SELECT l_suppkey, share, value FROM s WHERE r = least(ceil(round(n * share, 9)) + 1, n)""")
def index_percentiles(spark, sf_dir):
    return st.index_percentiles(_lines(spark, sf_dir).withColumnRenamed("l_extendedprice", "value"), "l_suppkey", "value", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(99, floor((l_extendedprice - lo) / ((hi - lo) / 100))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return st.histogram(_lines(spark, sf_dir), "l_extendedprice", 100).select("bin", "n")


@query("""SELECT count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS sd, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS greatest FROM lineitem""")
def score_describe(spark, sf_dir):
    return st.described(_lines(spark, sf_dir), "l_quantity").withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9)})


@query("""SELECT run_no, count(score) AS n, min(score) AS least, round(quantile_cont(score, 0.25), 9) AS q1, round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.75), 9) AS q3, max(score) AS greatest
FROM sim_scores WHERE score >= 0 AND score <= 1 AND NOT isnan(score) GROUP BY 1""")
def support_boxplot(spark, sf_dir):
    s = table(spark, sf_dir, "sim_scores").where("score >= 0.0 and score <= 1.0")
    d = st.described(s, "score", "run_no").drop("mean", "sd")
    return d.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query("""SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS total, round(avg(l_quantity), 2) AS mean, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1""")
def support_summary(spark, sf_dir):
    li = _lines(spark, sf_dir).select("l_returnflag", "l_quantity")
    sums = li.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"), F.round(F.avg("l_quantity"), 2).alias("mean"))
    return sums.join(st.quantiles(li, ["l_returnflag"], "l_quantity", [0.5]), "l_returnflag").select("l_returnflag", "total", "mean", F.col("q")[0].alias("median"))


@query("""SELECT round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
round(corr(l_extendedprice, l_quantity), 9) AS r, count(*) FILTER (WHERE l_extendedprice > 600) AS above FROM lineitem""")
def regression_summary(spark, sf_dir):
    r = st.regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice").drop("variance")
    return r.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "slope", "intercept")}).withColumn("r", F.round("r", 9))


@query("""WITH r AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, round(sum(CASE WHEN n = 1 THEN x ELSE x * pow(2, -(n - greatest(i, 2) + 1)) END), 9) AS halved, round(avg(x), 9) AS mean FROM r GROUP BY 1""")
def sequential_pair_mean(spark, sf_dir):
    m = st.running_mean(_lines(spark, sf_dir), ["l_orderkey"], "l_quantity", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return m.select("l_orderkey", F.round("halved", 9).alias("halved"), F.round("mean", 9).alias("mean"))


@query("""WITH v AS (SELECT o_orderkey, o_totalprice AS x FROM orders), r AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM v),
m AS (SELECT max(x) AS hi, min(x) AS lo FROM r WHERE r = ceil(n * 0.95::DOUBLE) OR r = n - ceil(n * 0.95::DOUBLE) + 1) SELECT o_orderkey, round(greatest(0, least(1, (x - lo) / (hi - lo))), 9) AS scaled FROM v, m""")
def normalize_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return st.normalised(o, "o_totalprice", 0.95).select("o_orderkey", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH g AS (SELECT l_suppkey, stddev_samp(l_extendedprice) * pow(count(*), -0.2::DOUBLE) AS h, min(l_extendedprice) + 20000 AS o FROM lineitem GROUP BY 1)
SELECT l_suppkey, any_value(o) AS observed, round(avg({phi_sql('((o - l_extendedprice) / h)')} - {phi_sql('((0 - l_extendedprice) / h)')}), 6) AS p FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1""")
def kde_pvalue(spark, sf_dir):
    li = _lines(spark, sf_dir).select("l_suppkey", "l_extendedprice")
    observed = li.groupBy("l_suppkey").agg((F.min("l_extendedprice") + 20000).alias("o"))
    return st.kde_pvalues(li.join(observed, "l_suppkey"), "l_suppkey", "l_extendedprice", "o").select("l_suppkey", "observed", F.round("p", 6).alias("p"))


@query()
def kde_overlap(spark, sf_dir):
    """Prices of returned lines against the others', by supplier."""
    li = _lines(spark, sf_dir).select("l_suppkey", "l_extendedprice", "l_returnflag")
    return st.kde_overlap(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), "l_suppkey", "l_extendedprice")


@query("SELECT l_suppkey, count(*) AS n, round((avg(l_quantity) - 25) * sqrt(count(*)) / stddev_samp(l_quantity), 6) AS t FROM lineitem GROUP BY 1")
def t_test(spark, sf_dir):
    return st.one_sample_t(_lines(spark, sf_dir), "l_suppkey", "l_quantity", 25.0).select("l_suppkey", "n", F.round("t", 6).alias("t"))


@query()
def t_test_pvalues(spark, sf_dir):
    return st.one_sample_t(_lines(spark, sf_dir), "l_suppkey", "l_quantity", 25.0)


@query("""WITH c AS (SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS d FROM lineitem), b AS (SELECT l_suppkey, count(*)::DOUBLE AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS g1, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS g2 FROM c GROUP BY 1),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0::DOUBLE * (n - 2))) AS y, 3.0::DOUBLE * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
 (g2 + 3 - 3.0::DOUBLE * (n - 1) / (n + 1)) / sqrt(24.0::DOUBLE * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6.0::DOUBLE * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0::DOUBLE * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM b WHERE n >= 20),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5::DOUBLE * ln(w2)) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS inner_ FROM w),
k AS (SELECT l_suppkey, CAST(n AS BIGINT) AS n, z1 * z1 + pow((1 - 2 / (9 * a) - sign(inner_) * pow(abs(inner_), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z)
SELECT l_suppkey, n, round(k2, 6) AS k2, round(exp(-k2 / 2), 6) AS p FROM k""")
def normality_test(spark, sf_dir):
    t = st.normality(_lines(spark, sf_dir), "l_suppkey", "l_extendedprice")
    return t.select("l_suppkey", "n", F.round("k2", 6).alias("k2"), F.round("p", 6).alias("p"))


@query()
def tukey_groups(spark, sf_dir):
    """Order prices by status within each priority."""
    return st.tukey_hsd(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("""WITH g AS (SELECT l_suppkey, min(l_extendedprice) + 1000 AS o FROM lineitem GROUP BY 1)
SELECT l_suppkey, any_value(o) AS observed, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd, count(*) AS n, round(any_value(o) - avg(l_extendedprice), 6) AS delta FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1""")
def null_summary(spark, sf_dir):
    li = _lines(spark, sf_dir).select("l_suppkey", "l_extendedprice")
    observed = li.groupBy("l_suppkey").agg((F.min("l_extendedprice") + 1000).alias("o"))
    s = st.null_summary(li.join(observed, "l_suppkey"), "l_suppkey", "l_extendedprice", "o")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "delta")})


@query("SELECT l_orderkey, l_linenumber, round((0.252::DOUBLE * l_quantity - ln(0.035::DOUBLE)) / ln(2), 9) AS bits FROM lineitem")
def bit_scores(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(bit_score(F.col("l_quantity")), 9).alias("bits"))


@query("""SELECT event_id, round(CASE WHEN m > 50 THEN 100 - m ELSE m END, 6) AS folded FROM (SELECT event_id, ((value * 3 - 20) % 100 + 100) % 100 AS m FROM events WHERE value IS NOT NULL)""")
def reflected_values(spark, sf_dir):
    """Values folded into 0..50."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.round(reflected(F.col("value") * 3 - 20, F.lit(0.0), F.lit(50.0)), 6).alias("folded"))


@query("""SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def rolling_history(spark, sf_dir):
    """The least and greatest of the last 1000 values of a chain."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-999, 0)
    return table(spark, sf_dir, "events").select("event_id", F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


@query("""SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 120""")
def top_results(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(120).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= round(n / 10)""")
def top_decile(spark, sf_dir):
    from seqloom.operators.dedup import with_row_number

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    r = with_row_number(o, "r", F.desc("o_totalprice"), "o_orderkey")
    n = o.agg(F.round(F.count(F.lit(1)) / 10).alias("n"))
    return r.crossJoin(F.broadcast(n)).where("r <= n").select("o_orderkey", "o_totalprice")


@query()
def shapiro_statistics(spark, sf_dir):
    return st.shapiro_tests(_lines(spark, sf_dir), "l_suppkey", "l_extendedprice")
