"""Per-market features, cluster tables, intraday decomposition and strike strips."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import cdf, density, probit
from oddsmill.operators.quantiles import exact
from oddsmill.operators.variance import ratio, slope_columns


#: What clusters are made from, and what else describes a market.
CLUSTER_FEATURES = ("xstill", "lam", "kz", "dlam", "ar1z")
DESCRIPTIONS = ("log_moves", "log_tres", "log_mdt", "still", "p_ext", "p_range", "spend_lr", "f1", "f2", "f3", "f4", "lump", "ar1")
EPS = 1e-12


def lag_one(x: str) -> Column:
    """Lag-1 autocorrelation of x within its group, from x and x_next: 0 under four pairs, within -1 and 1."""
    a, b = F.when(F.col(f"{x}_next").isNotNull(), F.col(x)), F.col(f"{x}_next")
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    spread = F.sqrt(F.greatest(F.var_pop(a) * F.var_pop(b), F.lit(0.0)))
    return F.when(F.count(b) >= 4, F.least(F.greatest(cov / (spread + EPS), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def fingerprints(raw: DataFrame, markets: DataFrame) -> DataFrame:
    """One row a market, by one aggregation over its moves; nothing of it tells the outcome.

    Moves are standardised by the probit rate; life counts a day at least. The features are CLUSTER_FEATURES and
    DESCRIPTIONS; n_moves, tot2, max2, t_res and p0 come with them.
    """
    w = Window.partitionBy("key").orderBy("ts_days")
    first = markets.groupBy("key").agg(F.greatest(F.max("t_res"), F.lit(1.0)).alias("t_res"), F.min_by("close", "ts_days").alias("p0"))
    low, high = grid.PRICE_CLIP
    rate = F.pow(density(probit(F.least(F.greatest("p", F.lit(low)), F.lit(high)))), 2) / F.greatest("tau", F.lit(1.0)) * F.col("dt")
    rows = raw.join(first, "key").withColumn("sig", F.sqrt(F.greatest(rate, F.lit(1e-12)))).withColumn("z", F.col("dp") / F.col("sig"))
    frac = (F.col("t_res") - F.col("tau")) / F.col("t_res")
    rows = rows.withColumns({"frac": frac, "z2": F.col("z") * F.col("z"), "dp_next": F.lead("dp").over(w), "z_next": F.lead("z").over(w)})
    fifth, late = F.least(F.greatest(F.floor(5 * F.col("frac")), F.lit(0)), F.lit(4)), F.col("frac") > 0.5
    still = (F.abs("dp") < 0.005).cast("double")
    share = lambda k: F.sum(F.when(fifth == k, F.col("dp2")).otherwise(0.0)) / (F.sum("dp2") + EPS)
    level = lambda side: F.log(F.avg(F.when(side, F.col("z2"))) + 1e-9)
    m2 = F.avg("z2")
    kurt = F.avg(F.col("z2") * F.col("z2")) / F.pow(F.greatest(m2, F.lit(EPS)), 2) - 3
    n, tot, top, p0, life = F.count("*"), F.sum("dp2"), F.max("dp2"), F.first("p0"), F.first("t_res")
    return rows.groupBy("key").agg(
        n.alias("n_moves"), tot.alias("tot2"), top.alias("max2"), life.alias("t_res"), p0.alias("p0"),
        F.avg(still - (2 * cdf(F.lit(0.005) / F.col("sig")) - 1)).alias("xstill"), F.log(m2 + 1e-9).alias("lam"),
        F.log(3 + F.greatest(kurt, F.lit(-2.9))).alias("kz"), F.coalesce(level(late) - level(~late), F.lit(0.0)).alias("dlam"), lag_one("z").alias("ar1z"),
        F.log(n.cast("double")).alias("log_moves"), F.log(life).alias("log_tres"), F.log(F.avg("dt") + EPS).alias("log_mdt"), F.avg(still).alias("still"),
        F.avg(F.abs(F.col("p") - 0.5)).alias("p_ext"), (F.max("p") - F.min("p")).alias("p_range"), F.log((tot + EPS) / (p0 * (1 - p0) + EPS)).alias("spend_lr"),
        *(share(k).alias(f"f{k + 1}") for k in range(4)), F.log((top + EPS) / (tot / n + EPS)).alias("lump"), lag_one("dp").alias("ar1"),
    )


def standardised(features: DataFrame, columns: list[str]) -> DataFrame:
    stats = features.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    rows = features.join(F.broadcast(stats))  # one row
    return rows.select("key", *(((F.col(c) - F.col(f"{c}_m")) / F.greatest(F.col(f"{c}_s"), F.lit(1e-9))).alias(c) for c in columns))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings from the counts of their cross table."""
    two = lambda n: n * (n - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    parts = [cells.agg(F.sum(two(F.col("n"))).alias("ij"))]
    for c, out in ((a, "i"), (b, "j")):
        parts.append(cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(out)))
    parts.append(cells.agg(two(F.sum("n")).alias("all")))
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))  # one row each
    expected = F.col("i") * F.col("j") / F.nullif(F.col("all"), F.lit(0.0))
    return row.select(((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0))).alias("ari"))


def intraday(pairs: DataFrame) -> DataFrame:
    """Bounce, jumps (one less the bipower share of the mid's pairs) and zeros of hourly moves by price bucket and over all (bucket -1), by grouping sets."""
    rows = pairs.withColumn("bucket", grid.price_bucket(F.col("p_prev")))
    both = F.col("ok_next")
    total, mid = F.sum(F.col("dp") * F.col("dp")), F.sum(F.col("dm") * F.col("dm"))
    roll = F.sum(F.when(both, F.col("dp") * F.col("dp_next")))
    n2 = F.sum(both.cast("int"))
    aggregated = [
        F.count("*").alias("n"), ratio(total - mid, total).alias("bounce_quote"),
        ratio(-2 * ratio(roll, n2.cast("double")) * F.count("*"), total).alias("bounce_roll"),
        (1 - math.pi / 2 * ratio(F.sum(F.when(both, F.abs(F.col("dm") * F.col("dm_next")))), F.sum(F.when(both, F.col("dm") * F.col("dm"))))).alias("jump_share_mid"),
        F.avg((F.col("dp") == 0).cast("double")).alias("frac_zero"),
    ]
    out = rows.rollup("bucket").agg(*aggregated)
    return out.withColumn("bucket", F.coalesce("bucket", F.lit(-1)))


def signature(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Per key the realised variance of hourly over daily closes within the span of the hourly ones, an hour to either side."""
    def squared(rows: DataFrame, out: str) -> DataFrame:
        d = F.col("close") - F.lag("close").over(Window.partitionBy("key").orderBy("ts"))
        return rows.withColumn("d", d).groupBy("key").agg(F.sum(F.col("d") * F.col("d")).alias(out))

    span = hourly.groupBy("key").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    inside = daily.join(span, "key").filter("ts between t0 - interval 1 hour and t1 + interval 1 hour").select("key", "ts", "close")
    return squared(hourly, "rv_h").join(squared(inside, "rv_d"), "key").filter("rv_d > 0").select("key", (F.col("rv_h") / F.col("rv_d")).alias("signature"))


#: Strike types that say that the value ends above the floor, or below the cap.
ABOVE, BELOW = ("greater", "greater_or_equal"), ("less", "less_or_equal")


def strip_bins(strikes: DataFrame, least: int = 5, brackets: int = 3) -> DataFrame:
    """Disjoint bins (event, ts, lo, hi, prob) of each event and time's markets (event, ts, strike_type, fs, cs, close).

    With `brackets` markets of type between or more these are the bins, with a tail of their median width above the
    highest floor of the greater ones and below the lowest cap of the less ones. Else the greater ones, if `least` at
    least have a floor, are a ladder: survival is their running minimum, bins its differences, with open tails of the
    median step.
    """
    one = Window.partitionBy("event", "ts")
    kind = F.when(F.col("strike_type") == "between", "b").when(F.col("strike_type").isin(*ABOVE), "a").when(F.col("strike_type").isin(*BELOW), "l")
    rows = strikes.select("event", "ts", "fs", "cs", "close", kind.alias("kind")).filter("kind is not null")
    rows = rows.withColumn("n_b", F.count(F.when(F.col("kind") == "b", 1)).over(one)).withColumn("n_a", F.count(F.when(F.col("kind") == "a", F.col("fs"))).over(one))
    bracketed = rows.filter(F.col("n_b") >= brackets)
    tails = bracketed.groupBy("event", "ts").agg(
        F.median(F.when(F.col("kind") == "b", F.col("cs") - F.col("fs"))).alias("width"),
        F.max_by(F.struct("fs", "close"), F.when(F.col("kind") == "a", F.col("fs"))).alias("a"),
        F.min_by(F.struct("cs", "close"), F.when(F.col("kind") == "l", F.col("cs"))).alias("l"),
    )
    inner = bracketed.filter("kind = 'b'").select("event", "ts", F.col("fs").alias("lo"), F.col("cs").alias("hi"), F.col("close").alias("prob"))
    outer = F.array(F.struct(F.col("a.fs").alias("lo"), (F.col("a.fs") + F.col("width")).alias("hi"), F.col("a.close").alias("prob")), F.struct((F.col("l.cs") - F.col("width")).alias("lo"), F.col("l.cs").alias("hi"), F.col("l.close").alias("prob")))
    outer = tails.select("event", "ts", F.explode(outer).alias("x")).select("event", "ts", "x.*").filter("prob is not null")
    ladder = rows.filter((F.col("n_b") < brackets) & (F.col("n_a") >= least) & (F.col("kind") == "a") & F.col("fs").isNotNull())
    return inner.unionByName(outer).unionByName(ladder_bins(ladder.select("event", "ts", F.col("fs").alias("k"), F.col("close").alias("p"))))


def ladder_bins(strikes: DataFrame) -> DataFrame:
    """Bins of a strike ladder (event, ts, k, p: price that the value ends above k): running minimum, differences, open tails."""
    w = Window.partitionBy("event", "ts").orderBy("k")
    rows = strikes.withColumn("s", F.min("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("s0", F.lag("s").over(w)).withColumn("k0", F.lag("k").over(w)).withColumn("width", F.col("k") - F.lag("k").over(w))
    width = F.median("width").over(Window.partitionBy("event", "ts"))
    rows = rows.withColumn("tail", width).withColumn("last", F.row_number().over(Window.partitionBy("event", "ts").orderBy(F.desc("k"))) == 1)
    body = rows.select("event", "ts", F.coalesce("k0", F.col("k") - F.col("tail")).alias("lo"), F.col("k").alias("hi"), (F.coalesce("s0", F.lit(1.0)) - F.col("s")).alias("prob"))
    top = rows.filter("last").select("event", "ts", F.col("k").alias("lo"), (F.col("k") + F.col("tail")).alias("hi"), F.col("s").alias("prob"))
    return body.unionByName(top)


def strip_moments(bins: DataFrame, ends: DataFrame, low: float = 0.7, high: float = 1.3, least_days: float = 2.0) -> DataFrame:
    """Moments and implied volatility a year of each strip (ends: event, ts, end, series, n_strikes).

    Strips whose probabilities sum to within bounds are scaled to one; those without variance or under `least_days`
    before their end are left out. iv_prop is of the value in proportion to its mean (null at a mean of 0), iv_norm of
    the value itself.
    """
    m = (F.col("lo") + F.col("hi")) / 2
    out = bins.groupBy("event", "ts").agg(F.sum("prob").alias("total"), F.sum(F.col("prob") * m).alias("a"), F.sum(F.col("prob") * m * m).alias("b"))
    out = out.filter(F.col("total").between(low, high)).withColumn("mean", F.col("a") / F.col("total"))
    out = out.withColumn("var", F.col("b") / F.col("total") - F.col("mean") * F.col("mean")).join(ends, ["event", "ts"])
    out = out.withColumn("tau_days", (F.unix_micros("end") - F.unix_micros("ts")) / 86400e6).filter((F.col("var") > 0) & (F.col("tau_days") >= least_days))
    std, root = F.sqrt("var"), F.sqrt(F.col("tau_days") / 365.25)
    return out.select("event", "ts", "series", "n_strikes", "total", "mean", std.alias("std"), "tau_days", (std / F.nullif(F.abs("mean"), F.lit(0.0)) / root).alias("iv_prop"), (std / root).alias("iv_norm"))


def with_iv(moments: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """moments with kind and iv: that in proportion for series of kind prop, the normal one for the others."""
    kind = F.coalesce(*(F.when(F.col("series") == s, k) for s, k in kinds.items()))
    return moments.withColumn("kind", kind).withColumn("iv", F.when(F.col("kind") == "prop", F.col("iv_prop")).otherwise(F.col("iv_norm")))


def iv_summary(ivs: DataFrame) -> DataFrame:
    """By series: kind, events, days, quartiles of iv, medians of days to the end and of total probability."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return ivs.groupBy("series").agg(
        F.first("kind").alias("kind"), F.count_distinct("event").alias("events"), F.count("*").alias("days"), q("iv", 0.5).alias("med_iv"), q("iv", 0.25).alias("q25"), q("iv", 0.75).alias("q75"),
        q("tau_days", 0.5).alias("med_tau"), q("total", 0.5).alias("med_total_prob"),
    )


def iv_terms(ivs: DataFrame, bins: int = 12) -> DataFrame:
    """Term structure: by series and quantile bin of the days to the end, median days and quartiles of iv."""
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = ivs.groupBy("series").agg(F.array_distinct(F.percentile("tau_days", at)).alias("edges"))
    rows = ivs.join(edges, "series").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("tau_days"))))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rows.groupBy("series", "bin").agg(F.count("*").alias("n"), q("tau_days", 0.5).alias("tau"), q("iv", 0.5).alias("med"), q("iv", 0.25).alias("q25"), q("iv", 0.75).alias("q75"))


def categories(tags: DataFrame, most: int = 4) -> DataFrame:
    """(event, category): each event's globally most frequent tag (the first of equal ones), all but the `most` largest as other."""
    rows = tags.select("event", F.posexplode("tags").alias("pos", "tag"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("n"))
    best = rows.join(counts, "tag").groupBy("event").agg(F.max_by("tag", F.struct("n", -F.col("pos"))).alias("tag"))
    top = best.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most).select("tag", F.lit(True).alias("top"))
    return best.join(F.broadcast(top), "tag", "left").select("event", F.when(F.col("top"), F.col("tag")).otherwise("other").alias("category"))


def long_enough(bars: DataFrame, least: int = 48) -> DataFrame:
    """Bars of the keys with `least` bars or more."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy("key"))).filter(F.col("_n") >= least).drop("_n")


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    got = exact(rows, {value: [0.25, 0.5, 0.75]})[value]
    return rows.agg(F.count(value).alias("n"), *(F.lit(x).cast("double").alias(c) for x, c in zip(got, ("q25", "med", "q75"), strict=True)))


def cluster_cards(features: DataFrame, markets: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    """By cluster (labels: key, cluster): size, share, feature means, budget slope with its error, share of the terminal jump, and the most frequent category (the first by name of equal ones)."""
    last = markets.groupBy("key").agg(F.pow(F.max("final") - F.max_by("close", "ts_days"), 2).alias("term"))
    rows = features.join(last, "key").join(labels, "key").withColumn("x", F.col("p0") * (1 - F.col("p0"))).withColumn("y", F.col("tot2") + F.col("term"))
    slope, se = slope_columns(F.col("x"), F.col("y"))
    means = [F.avg(c).alias(c) for c in (*CLUSTER_FEATURES, *DESCRIPTIONS)]
    cards = rows.groupBy("cluster").agg(F.count("*").alias("n_mkts"), *means, slope.alias("budget_slope"), se.alias("budget_se"), (F.sum("term") / (F.sum("tot2") + F.sum("term") + EPS)).alias("term_share"))
    cards = cards.withColumn("share", F.col("n_mkts") / F.sum("n_mkts").over(Window.partitionBy()))
    held = rows.join(categories, "key").groupBy("cluster", "category").agg(F.count("*").alias("n"))
    held = held.groupBy("cluster").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("top_cat"), (F.max("n") / F.sum("n")).alias("top_cat_frac"))
    return cards.join(held, "cluster", "left")


def daily_variance(bars: DataFrame) -> DataFrame:
    """Sum of the squared close-to-close moves of each key; 0 for a single bar."""
    move = F.col("close") - F.lag("close").over(Window.partitionBy("key").orderBy("ts"))
    return bars.select("key", F.coalesce(move * move, F.lit(0.0)).alias("m")).groupBy("key").agg(F.sum("m").alias("rv"))


def summary(rows: DataFrame, by: str, unit: str, value: str) -> DataFrame:
    """Different units, rows, median and quartiles (interpolated) of a value in each group."""
    parts = [F.percentile(value, q).alias(n) for n, q in (("med", 0.5), ("q25", 0.25), ("q75", 0.75))]
    return rows.groupBy(by).agg(F.countDistinct(unit).alias("units"), F.count("*").alias("n"), *parts)


def load_strips(catalog: DataFrame, bars: DataFrame, series: list[str], least: int = 5) -> DataFrame:
    """Bars of the listed series' markets with a numeric floor or cap, in events with at least `least` of them: (event, series, key, strike_type, end, ts, close, fs, cs)."""
    rows = catalog.filter(F.col("series").isin(series)).withColumn("fs", F.expr("try_cast(floor AS double)")).withColumn("cs", F.expr("try_cast(cap AS double)"))
    rows = rows.filter("fs is not null or cs is not null").withColumn("n", F.count("*").over(Window.partitionBy("event"))).filter(F.col("n") >= least)
    return bars.join(rows.select("key", "event", "series", "strike_type", "end", "fs", "cs"), "key").select("event", "series", "key", "strike_type", "end", "ts", "close", "fs", "cs")


def claims(quoted: DataFrame, computed: DataFrame) -> DataFrame:
    """Quoted values (name, quoted, tol) against computed ones (name, value): ok where they differ by tol at most; a missing value is not ok."""
    rows = quoted.join(computed, "name", "left")
    return rows.select("name", "quoted", "value", F.coalesce(F.abs(F.col("value") - F.col("quoted")) <= F.col("tol"), F.lit(False)).alias("ok"))
