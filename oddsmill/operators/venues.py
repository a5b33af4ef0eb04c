"""Cross-venue statistics of aligned price pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddsmill.operators.variance import ratio, solve3


def by_pair() -> WindowSpec:
    return Window.partitionBy("pair_id")


def in_time() -> WindowSpec:
    return by_pair().orderBy("ts")


def aligned(pairs: DataFrame, bars: DataFrame, unit: str = "day", shift: str | None = None, least: int = 3) -> DataFrame:
    """(pair_id, ts, p_k, p_pm): last closes of both venues by floored time; pairs with `least` rows.

    Bars of k are stamped where they begin, those of pm are points at their label, so that k's are shifted by their
    length: a unit, unless `shift` says otherwise.
    """
    shift = shift or f"1 {unit}"

    def side(key: str, out: str, by: str) -> DataFrame:
        rows = pairs.select("pair_id", F.col(key).alias("key")).join(bars, "key")
        at = F.date_trunc(unit, F.col("ts")) + F.expr(f"INTERVAL {by}")
        return rows.groupBy("pair_id", at.alias("ts")).agg(F.max_by("close", F.col("ts")).alias(out))

    met = side("k_key", "p_k", shift).join(side("pm_key", "p_pm", "0 days"), ["pair_id", "ts"])
    return met.withColumn("n", F.count("*").over(by_pair())).filter(F.col("n") >= least).drop("n")


def gap_stats(panel: DataFrame) -> DataFrame:
    g = panel.withColumn("g", F.col("p_k") - F.col("p_pm"))
    rows = g.withColumn("d", F.col("g") - F.avg("g").over(by_pair())).withColumn("d1", F.lag("d").over(in_time()))
    x = F.when(F.col("d1").isNotNull(), F.col("d1"))
    rho = F.sum(F.col("d") * x) / F.nullif(F.sum(x * x), F.lit(0.0))
    a = F.abs("g")
    out = rows.agg(F.count("*").alias("n"), F.avg(a).alias("mean_abs"), F.median(a).alias("median_abs"), F.sqrt(F.avg(F.col("g") * F.col("g"))).alias("rms"), F.avg((a > 0.05).cast("double")).alias("share_wide"), rho.alias("ar1"))
    return out.withColumn("half_life", F.when((F.abs("ar1") < 1) & (F.col("ar1") != 0), F.log(F.lit(0.5)) / F.log(F.abs("ar1"))))


def gap_by(panel: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Observations and mean absolute gap by a column of the pairs (domain, quality)."""
    rows = panel.join(pairs.select("pair_id", column), "pair_id")
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p_pm") - F.col("p_k"))).alias("mean_abs"))


def paired_budget(panel: DataFrame, least: float = 1e-4) -> DataFrame:
    """Per pair: realised variance over p0 (1 - p0) of each venue and the ratio of the two."""
    rows = panel.withColumn("dk", F.col("p_k") - F.lag("p_k").over(in_time())).withColumn("dm", F.col("p_pm") - F.lag("p_pm").over(in_time()))
    out = rows.groupBy("pair_id").agg(F.sum(F.col("dk") * F.col("dk")).alias("ss_k"), F.sum(F.col("dm") * F.col("dm")).alias("ss_pm"), F.min_by("p_k", "ts").alias("p0_k"), F.min_by("p_pm", "ts").alias("p0_pm"), F.count("*").alias("n"))
    out = out.withColumn("bud_k", F.col("p0_k") * (1 - F.col("p0_k"))).withColumn("bud_pm", F.col("p0_pm") * (1 - F.col("p0_pm"))).filter((F.col("bud_k") > least) & (F.col("bud_pm") > least))
    out = out.withColumn("ratio_k", F.col("ss_k") / F.col("bud_k")).withColumn("ratio_pm", F.col("ss_pm") / F.col("bud_pm"))
    return out.withColumn("ratio_of_ratios", ratio(F.col("ratio_k"), F.col("ratio_pm")))


def paired_summary(budget: DataFrame) -> DataFrame:
    r = F.col("ratio_of_ratios")
    return budget.agg(F.count("*").alias("n"), F.median(r).alias("median_ratio"), F.avg((r > 1).cast("double")).alias("share_above"))


def paired_power(panel: DataFrame, side: str, bins: int = 14, least: float = 1e-6) -> DataFrame:
    """(n_obs, bins, gamma): slope of log mean squared move on log mean p(1-p) over quantile bins of the moves that start above `least`; the largest value joins the last bin."""
    rows = panel.withColumn("dp", F.lead(side).over(in_time()) - F.col(side)).withColumn("pq", F.col(side) * (1 - F.col(side))).filter((F.col("pq") > least) & F.col("dp").isNotNull())
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    rows = rows.join(F.broadcast(rows.agg(F.array_distinct(F.percentile("pq", at)).alias("edges"))))  # one row
    rows = rows.withColumn("qi", F.least(F.size(F.filter("edges", lambda e: e <= F.col("pq"))) - 1, F.size("edges") - 2))
    cells = rows.groupBy("qi").agg(F.avg("pq").alias("level"), F.avg(F.col("dp") * F.col("dp")).alias("m"), F.count("*").alias("n"))
    used = F.col("m") > 0
    return cells.agg(F.sum("n").alias("n_obs"), F.sum(used.cast("long")).alias("bins"), F.regr_slope(F.when(used, F.log("m")), F.when(used, F.log("level"))).alias("gamma"))


def moves(panel: DataFrame) -> DataFrame:
    return panel.select("pair_id", "ts", (F.col("p_k") - F.lag("p_k").over(in_time())).alias("dk"), (F.col("p_pm") - F.lag("p_pm").over(in_time())).alias("dm")).filter("dk is not null")


def cross_correlation(panel: DataFrame, most: int = 3) -> DataFrame:
    """corr(dk, dm) at lags -most..most; positive lags shift dm, negative ones dk."""
    rows, out = moves(panel), []
    for k in range(-most, most + 1):
        a, b = (F.col("dk"), F.lag("dm", k).over(in_time())) if k > 0 else (F.lag("dk", -k).over(in_time()) if k else F.col("dk"), F.col("dm"))
        rows = rows.withColumn(f"a{k + most}", F.when(b.isNotNull() & a.isNotNull(), a)).withColumn(f"b{k + most}", F.when(b.isNotNull() & a.isNotNull(), b))
        out.append(F.struct(F.lit(k).alias("lag"), F.corr(f"a{k + most}", f"b{k + most}").alias("corr")))
    return rows.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def predictive(panel: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of y's move on 1, its own last move and x's last move: coefficients, and t of the latter."""
    rows = moves(panel)
    rows = rows.select(F.col(y).alias("y"), F.lag(y).over(in_time()).alias("a"), F.lag(x).over(in_time()).alias("b")).filter("a is not null and b is not null")
    a, b, v = F.col("a"), F.col("b"), F.col("y")
    one = F.lit(1.0)
    sums = {"w": one, "wa": a, "wb": b, "waa": a * a, "wab": a * b, "wbb": b * b, "wy": v, "way": a * v, "wby": b * v, "yy": v * v}
    got = rows.agg(*(F.sum(e).alias(k) for k, e in sums.items()))
    c0, c1, c2 = solve3({k: F.col(k) for k in sums if k != "yy"})
    got = got.withColumns({"const": c0, "own": c1, "cross": c2})
    sse = F.col("yy") - F.col("const") * F.col("wy") - F.col("own") * F.col("way") - F.col("cross") * F.col("wby")
    w, wa, wb, waa, wab, wbb = (F.col(k) for k in ("w", "wa", "wb", "waa", "wab", "wbb"))
    det = w * (waa * wbb - wab * wab) - wa * (wa * wbb - wab * wb) + wb * (wa * wab - waa * wb)
    se = F.sqrt(sse / (w - 3) * (w * waa - wa * wa) / F.nullif(det, F.lit(0.0)))
    return got.select(F.col("w").cast("long").alias("n"), "const", "own", "cross", (F.col("cross") / F.nullif(se, F.lit(0.0))).alias("t_cross"))
