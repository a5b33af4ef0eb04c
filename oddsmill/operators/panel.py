"""Panels of moves from per-key bars. Every window is partitioned by key, so that a chain of them shares one shuffle."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import probit

# Bounds of a tick's edges before their probit.
EDGE_CLIP = (1e-4, 1 - 1e-4)


def by_key() -> WindowSpec:
    return Window.partitionBy("key")


def in_time() -> WindowSpec:
    return by_key().orderBy("ts_days")


def load_markets(bars: DataFrame, catalog: DataFrame, least: int = 5) -> DataFrame:
    """(key, ts_days, close, final, t_res): bars of resolved markets with at least `least` of them, closes clipped to [0, 1]."""
    resolved = catalog.filter("closed and final_price in (0.0, 1.0)").select("key", F.col("final_price").alias("final"))
    rows = bars.filter("close is not null").join(resolved, "key")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(by_key())) / 86400e6
    rows = rows.withColumn("n", F.count("*").over(by_key())).withColumn("ts_days", days).filter(F.col("n") >= least)
    return rows.select("key", "ts_days", F.least(F.greatest("close", F.lit(0.0)), F.lit(1.0)).alias("close"), "final", F.max("ts_days").over(by_key()).alias("t_res"))


def raw_panel(markets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each pair of consecutive closes: (key, ts_days, p, dp, dp2, dt, tau); by: what tells series apart (key)."""
    by = by or ["key"]
    w = Window.partitionBy(*by).orderBy("ts_days")
    rows = markets.withColumn("next", F.lead("close").over(w)).withColumn("after", F.lead("ts_days").over(w)).filter("after is not null")
    dp = F.col("next") - F.col("close")
    return rows.select(*by, "ts_days", F.col("close").alias("p"), dp.alias("dp"), (dp * dp).alias("dp2"), (F.col("after") - F.col("ts_days")).alias("dt"), (F.col("t_res") - F.col("ts_days")).alias("tau"))


def move_panel(markets: DataFrame) -> DataFrame:
    """The raw panel within the clipped prices, time to resolution of a day at least, with the candidate rates."""
    low, high = grid.PRICE_CLIP
    rows = raw_panel(markets).withColumn("tau", F.greatest("tau", F.lit(1.0))).filter((F.col("p") > low) & (F.col("p") < high) & (F.col("dt") > 0))
    return rows.withColumns(grid.rates(F.col("p"), F.col("dt"), F.col("tau")))


def with_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pi", grid.price_bucket(F.col("p"))).withColumn("ti", grid.tau_band(F.col("tau")))


def standardised(moves: DataFrame) -> DataFrame:
    z = F.col("dp") / F.sqrt(F.greatest("v_gauss", F.lit(1e-12)))
    return moves.withColumn("z", z).withColumn("lam", F.col("z") * F.col("z"))


def segments(markets: DataFrame, p_low: float, p_high: float, tau_low: float, gap: float = 3.0, least: int = 8, unit: float | None = None) -> DataFrame:
    """Runs of closes within a rectangle without a gap of over `gap` days, `least` long at least: (key, run, pos, z, dt, taup).

    z is the probit of the clipped close; dt and taup (days to resolution of the close before, a day at least) are null
    at the start of a run. With a tick unit also zlo and zhi, the probits of the tick's edges, and isz: no tick moved.
    """
    tau = F.greatest(F.col("t_res") - F.col("ts_days"), F.lit(1.0))
    rows = markets.withColumn("tau", tau).withColumn("ok", (F.col("close") >= p_low) & (F.col("close") < p_high) & (F.col("tau") >= tau_low))
    step = F.coalesce(F.col("ts_days") - F.lag("ts_days").over(in_time()) > gap, F.lit(False))
    rows = rows.withColumn("brk", (~F.col("ok") | step).cast("int"))
    rows = rows.withColumn("run", F.sum("brk").over(in_time().rowsBetween(Window.unboundedPreceding, 0))).filter("ok")
    within = Window.partitionBy("key", "run")
    rows = rows.withColumn("len", F.count("*").over(within)).filter(F.col("len") >= least)
    ordered = within.orderBy("ts_days")
    low, high = grid.PRICE_CLIP
    clipped = F.least(F.greatest("close", F.lit(low)), F.lit(high))
    out = [(F.row_number().over(ordered) - 1).alias("pos"), probit(clipped).alias("z"), (F.col("ts_days") - F.lag("ts_days").over(ordered)).alias("dt"), F.lag("tau").over(ordered).alias("taup")]
    if unit is not None:
        edge = lambda c: probit(F.least(F.greatest(c, F.lit(EDGE_CLIP[0])), F.lit(EDGE_CLIP[1])))
        still = F.bround((F.col("close") - F.lag("close").over(ordered)) / unit) == 0
        out += [edge(clipped - unit / 2).alias("zlo"), edge(clipped + unit / 2).alias("zhi"), F.coalesce(still, F.lit(False)).alias("isz")]
    return rows.select("key", "run", *out)


def subsample(segs: DataFrame, most: int, seed: int = 7, by: list[str] | None = None) -> DataFrame:
    """Whole segments of each group in the order of a hash of seed, key and run, through the first that brings the group's steps to `most`.

    The order is cut into chunks by the hash, so that no task numbers all segments of a group.
    """
    by = by or []
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), F.col("run")))
    sizes = segs.groupBy(*by, "key", "run").agg((F.count("*") - 1).alias("steps")).withColumn("u", u).withColumn("chunk", F.substring("u", 1, 3))
    chunks = sizes.groupBy(*by, "chunk").agg(F.sum("steps").alias("own"))
    chunks = chunks.withColumn("chunks_before", F.sum("own").over(Window.partitionBy(*by).orderBy("chunk")) - F.col("own")).drop("own")  # 4096 rows a group at most
    within = Window.partitionBy(*by, "chunk").orderBy("u", "key", "run").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.join(F.broadcast(chunks) if not by else chunks, [*by, "chunk"]).withColumn("before", F.col("chunks_before") + F.sum("steps").over(within) - F.col("steps"))
    return segs.join(sizes.filter(F.col("before") < most).select(*by, "key", "run"), [*by, "key", "run"], "left_semi")


def hourly_pairs(bars: DataFrame) -> DataFrame:
    """Hourly moves of close and mid that are an hour apart, with the next ones if they are too."""
    mid = F.coalesce((F.col("bid") + F.col("ask")) / 2, F.col("close"))
    w = by_key().orderBy("ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = bars.withColumn("mid", mid).withColumn("sec", seconds)
    rows = rows.withColumn("dp", F.col("close") - F.lag("close").over(w)).withColumn("dm", F.col("mid") - F.lag("mid").over(w))
    rows = rows.withColumn("p_prev", F.lag("close").over(w)).withColumn("ok", F.coalesce(F.col("sec") - F.lag("sec").over(w) == 3600, F.lit(False)))
    for c in ("dp", "dm", "ok"):
        rows = rows.withColumn(f"{c}_next", F.lead(c).over(w))
    return rows.filter("ok").select("key", "ts", "dp", "dm", "p_prev", "dp_next", "dm_next", F.coalesce("ok_next", F.lit(False)).alias("ok_next"))


def start_states(markets: DataFrame, bands=(30.0, 14.0, 7.0, 3.0), near: float = 0.4, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Per key and band the observation nearest to that many days before resolution (the earliest of equal ones), if it is near enough, not the last and priced within bounds."""
    rows = markets.withColumn("idx", F.row_number().over(in_time()) - 1).withColumn("last", F.count("*").over(by_key()) - 1)
    rows = rows.withColumn("tau", F.col("t_res") - F.col("ts_days")).withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    best = rows.groupBy("key", "band").agg(F.min_by(F.struct("idx", "last", "tau", F.col("close").alias("p0")), F.struct(F.abs(F.col("tau") - F.col("band")), "idx")).alias("b"))
    out = best.select("key", "band", "b.*")
    return out.filter((F.abs(F.col("tau") - F.col("band")) <= near * F.col("band")) & (F.col("idx") < F.col("last")) & F.col("p0").between(low, high)).drop("last")


def remaining_variance(markets: DataFrame, starts: DataFrame, jump: float = 0.02) -> DataFrame:
    """Realised variance from each start on, in small moves and jumps, and the terminal jump."""
    rows = markets.withColumn("idx", F.row_number().over(in_time()) - 1).withColumn("dp", F.lead("close").over(in_time()) - F.col("close"))
    met = starts.select("key", "band", F.col("idx").alias("from"), "p0").join(rows, "key").filter("idx >= from")
    dp2, big = F.col("dp") * F.col("dp"), F.abs(F.col("dp")) >= jump
    return met.groupBy("key", "band", "p0").agg(
        F.sum(F.when(~big, dp2).otherwise(0.0)).alias("small"),
        F.sum(F.when(big, dp2).otherwise(0.0)).alias("jumps"),
        F.max_by(F.pow(F.col("final") - F.col("close"), 2), "idx").alias("terminal"),
    )


def folds(catalog: DataFrame, bounds=((0.0, 0.5, 0.75), (0.0, 0.75, 1.0)), most_test: int | None = None, seed: int = 7) -> DataFrame:
    """Walk-forward folds of the keys in the order in which they end (null first): train up to a share, test to the next.

    With `most_test` at most as many of the test keys stay, the first by a hash of seed and key. Keys are numbered by day
    of their end: the days' counts are summed up first, so that no task sorts the whole catalog.
    """
    rows = catalog.select("key", "end", F.coalesce(F.unix_date(F.col("end").cast("date")), F.lit(-(1 << 31))).alias("day"))
    days = rows.groupBy("day").agg(F.count("*").alias("own"))
    days = days.withColumn("before", F.sum("own").over(Window.orderBy("day")) - F.col("own")).withColumn("n", F.sum("own").over(Window.partitionBy())).drop("own")  # a row a day
    rows = rows.join(F.broadcast(days), "day").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy(F.col("end").asc_nulls_first(), "key")) - 1)
    parts = [F.struct(F.lit(k).alias("fold"), F.when(F.col("i") < F.floor(F.lit(lo) * F.col("n")), "train").when(F.col("i") < F.floor(F.lit(hi) * F.col("n")), "test").alias("part")) for k, (_, lo, hi) in enumerate(bounds)]
    out = rows.select("key", F.explode(F.array(*parts)).alias("f")).select("key", "f.fold", "f.part").filter("part is not null")
    if most_test is None:
        return out
    drawn = F.row_number().over(Window.partitionBy("fold").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), "key"))
    test = out.filter("part = 'test'").withColumn("r", drawn).filter(F.col("r") <= most_test).drop("r")
    return out.filter("part = 'train'").unionByName(test)


def random_split(keys: DataFrame, share: float = 0.3, seed: int = 7) -> DataFrame:
    """keys with is_test: a share of the keys by a hash of seed and key, so that reruns and added keys change no other key's side."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return keys.withColumn("is_test", u < share)
