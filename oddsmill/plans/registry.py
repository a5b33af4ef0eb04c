"""Named queries over the test tables, and DuckDB SQL with the same results."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import grid, normal
from oddsmill.operators import cube, fits, forecasts, markets, matching, mixtures, panel, regimes, states, variance, venues
from oddsmill.plans.market import View
from oddsmill.plans.oracles import SQL
from oddsmill.sources import appended, backfill, store

#: Floors for the small test tables, in both dialects.
CELL, FIT = 20, 10
KINDS = {"click": "prop", "view": "norm", "purchase": "norm"}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (no negative zero), integers as long: engines add doubles in different orders."""
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "double":
            return (F.round(c, 6) + F.lit(0.0)).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c

    return df.select(*(one(*x) for x in df.dtypes))


def _fixture(v: View, rows: list[tuple], schema: str) -> DataFrame:
    return v.spark.createDataFrame(rows, schema)


CUTOFF = "2024-01-20 00:00:00+00:00"


def _numbers(v: View) -> DataFrame:
    """A number of each event in one of its generations, some unparsable."""
    i, x = F.col("event_id"), F.when(F.col("event_id") % 16 < 2, "bad").otherwise(F.col("value").cast("string"))
    cents = F.floor(F.col("value") * 100).cast("string")
    rows = v.events.select("event_id", F.when(i % 5 == 0, x).alias("dollars"), F.when(i % 5 == 1, x).alias("fp"), F.when(i % 5 == 2, cents).when(i % 5 == 3, x).when(i % 5 == 0, "97").alias("legacy"), (i % 5 == 3).alias("is_string"))
    return rows.select("event_id", store.number(F.col("dollars"), F.col("fp"), F.col("legacy"), F.col("is_string"), True).alias("value"))


def _candles(v: View) -> DataFrame:
    """Candles of the hourly bars: none traded in every third hour, and some of those have no ask."""
    hour = F.floor(F.unix_micros("ts") / 3600000000)
    traded = hour % 3 != 0
    rows = v.bars("hour").withColumn("hour", hour)
    part = lambda x: F.when(F.col("hour") % 3 != 0, x)
    raw = rows.select("key", (F.col("hour") * 3600).alias("end"), part(F.col("close") - 0.01).alias("open"), part(F.col("close") + 0.02).alias("high"), part(F.col("close") - 0.02).alias("low"), F.when(traded, F.col("close")).alias("close"), "bid", F.when(F.col("hour") % 6 != 0, F.col("ask")).alias("ask"))
    return store.candles(raw)


def _times(v: View) -> DataFrame:
    """Event times as ISO text in several forms."""
    i, text = F.col("event_id"), lambda form: F.date_format("ts", form)
    raw = F.when(i % 6 == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 6 == 1, text("yyyy-MM-dd'T'HH:mm:ss")).when(i % 6 == 2, text("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(i % 6 == 3, text("yyyy-MM-dd")).when(i % 6 == 4, "").otherwise("soon")
    return v.prices.select("event_id", raw.alias("raw")).select("event_id", store.utc(F.col("raw")).alias("ts"))


def _lines(v: View) -> DataFrame:
    i, line = F.col("i"), F.to_json(F.struct(F.concat(F.lit("m"), "i").alias("ticker"), F.when(F.col("i") % 7 != 1, F.col("v")).alias("volume")))
    return v.catalog_texts().select(F.when(i % 5 == 4, "").when(i % 7 == 3, '{"ticker": "m').otherwise(line).alias("value"))


def _tag_objects(v: View) -> DataFrame:
    own = F.concat(F.lit('{"tags": [{"label": "'), "event_type", F.lit('"}, {"label": ""}, {"slug": "z"}, {"label": "k'), F.col("event_id") % 7, F.lit('"}]}'))
    return v.events.select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 10 == 9, '{"tags": [').when(F.col("event_id") % 10 == 8, "{}").otherwise(own).alias("json"))


QUOTED = [("markets of venue 0", 5.0, 1e9), ("markets of venue 1", -5.0, 1.0), ("markets of venue 2", 0.0, 1.0)]


def _ticker() -> Column:
    return F.concat(F.lit("S"), F.col("user_id") % 3, F.lit("-"), F.col("key"))


def _tickers(v: View) -> DataFrame:
    """The catalog under tickers of three series, with events and strikes as text, not all of them numeric."""
    i = F.col("user_id")
    rows = v.prices.groupBy("key", "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.round(F.sum("value"), 4).alias("volume")).withColumn("strike_type", F.when(i % 2 == 0, "greater").otherwise("between"))
    strike = F.when(i % 4 == 0, "above").otherwise((i % 11 / 2).cast("string"))
    rows = rows.withColumn("series", F.concat(F.lit("S"), i % 3)).withColumn("event", F.concat(F.lit("E"), i % 9)).withColumn("floor", strike).withColumn("cap", F.when(i % 8 == 0, "1.5"))
    return rows.withColumn("key", _ticker())


def _spans(v: View) -> DataFrame:
    """The catalog with settlement times for one venue."""
    late = F.when(F.col("venue") == 1, F.col("end") + F.expr("INTERVAL 2 DAYS"))
    return v.catalog().withColumn("until", store.window_end(F.col("end"), late))


def _upsert(v: View) -> DataFrame:
    bars = v.bars("day").select("key", "ts", "close")
    new = bars.filter(F.col("close") > 0.5).withColumn("close", F.col("close") + 0.001)
    return store.latest(bars, new, ["key", "ts"]).select("key", "ts", "close")


def _attempts(v: View) -> DataFrame:
    return backfill.attempts(v.catalog(), v.payloads(), v.catalog().filter("key % 6 = 0"))


def _outcomes(v: View) -> DataFrame:
    letters = v.catalog().filter("key % 20 = 3").select("key", F.lit(2).alias("attempts"))
    return backfill.outcomes(_attempts(v), backfill.parsed_bars(_attempts(v), 60), letters)


def _stored(v: View) -> DataFrame:
    """Daily bars, then those of them that changed, committed by phases to a store of its own, compacted for one of the venues' frequencies and read back."""
    bars = v.bars("day").select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("venue"), F.lit("1d").alias("freq"), "key", "ts", "close")
    changed = bars.filter(F.col("close") > 0.5).withColumn("close", F.col("close") + 0.001)
    kept = appended.Store(v.spark, f"{appended.shared_dir(v.spark)}/bars-{uuid.uuid4().hex}", buckets=8)
    appended.run_phases(kept, {"first": lambda s: {"bars": bars}, "even": lambda s: {"bars": changed.filter("venue = 'even'")}})
    kept.compact("bars")
    appended.run_phases(kept, {"first": lambda s: {"bars": bars}, "odd": lambda s: {"bars": changed.filter("venue = 'odd'")}})
    return kept.read("bars").select("key", "ts", "close")


def _catalog_upsert(v: View) -> DataFrame:
    old = v.catalog().select("key", "venue", "volume")
    new = old.filter("venue = 1").select("key", "venue", (F.col("volume") + 1).alias("volume"), F.lit("x").alias("slug"))
    return store.latest(old, new, ["key"]).select("key", "venue", "volume", "slug")


def _grid(v: View) -> DataFrame:
    p = v.raw()
    return p.select("key", "ts_days", grid.price_bucket(F.col("p")).alias("bucket"), grid.price_label(grid.price_bucket(F.col("p"))).alias("label"), grid.tau_band(F.col("tau")).alias("band"), grid.tau_label(grid.tau_band(F.col("tau"))).alias("tau_label"), grid.distance_bucket(F.col("p")).alias("di"), grid.folded_ticks(F.col("p"), F.col("dp"), 0.01).alias("ticks"))


def _normal(v: View) -> DataFrame:
    x = v.prices.select("close").distinct()
    return x.select("close", normal.probit(F.col("close")).alias("z"), normal.cdf(F.col("close") * 4 - 2).alias("cdf"), normal.density(F.col("close")).alias("pdf"))


def _budgets(v: View) -> DataFrame:
    return variance.lifetime_budget(v.markets())


def _units(v: View) -> DataFrame:
    rows = variance.lifetime_budget(v.markets()).withColumn("bucket", grid.price_bucket(F.col("p0")))
    return rows.select("bucket", F.col("rv").alias("num"), F.col("iv").alias("den"), F.col("key").cast("long").alias("ord"))


def _clustered(v: View) -> DataFrame:
    rows = v.moves().withColumn("bucket", grid.price_bucket(F.col("p")))
    return rows.groupBy("bucket", F.col("key").cast("long").alias("ord")).agg(F.sum("dp2").alias("num"), F.sum("v_gauss").alias("den"))


def _cells(v: View) -> DataFrame:
    return cube.map_cells(cube.moments(v.moves()), CELL, FIT, pairs=10)


def _driver(v: View, moves: DataFrame) -> DataFrame:
    cells = cube.written(cube.map_cells(cube.moments(moves), CELL, FIT, pairs=10), "map")
    return cube.map_rows(cells, regimes.rectangle(cells))


def _segments(v: View) -> DataFrame:
    return panel.segments(v.markets(), 0.30, 0.85, 1.0, unit=0.01)


def _aligned(v: View) -> DataFrame:
    return venues.aligned(v.pairs(), v.bars("day"))


def _features(v: View) -> DataFrame:
    return markets.fingerprints(v.raw(), v.markets())


def _listed(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of numbers as text."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in names})


def _moments(v: View) -> DataFrame:
    return markets.strip_moments(markets.strip_bins(v.strips()), v.strip_ends())


#: Given parameters, to test what follows from them in both engines.
TICKS = dict(zip(fits.HAZARD, (0.4, 0.1, 1.3, 0.6, 0.5, 0.7), strict=True))
STATE = {"c": 0.3, "alpha": 0.6, "eta": 0.1, "phi": 0.8, "s": 0.6}
TWO = {"w": [0.4, 0.6], "mu": [[0.0, 1.0], [0.3, 4.0]], "cov": [[[0.5, 0.1], [0.1, 2.0]], [[0.2, -0.1], [-0.1, 3.0]]]}


def _histogram(v: View) -> DataFrame:
    return regimes.tick_histogram(regimes.tick_rows(v.raw(), None, 0.01))


def _tick_masses(v: View) -> DataFrame:
    return _histogram(v).select("di", "ti", "k", fits.tick_mass(F.col("k"), {c: F.lit(x) for c, x in TICKS.items()}).alias("mass"))


def _tick_summary(v: View) -> DataFrame:
    h = _histogram(v)
    given = h.groupBy("di", "ti").agg(F.sum("n").alias("n")).select("*", *(F.lit(x).alias(c) for c, x in TICKS.items()), F.lit(-1.0).alias("ll_per_obs"))
    return fits.hazard_summary(given, h)


def _arrival(v: View) -> DataFrame:
    cells = regimes.endgame_cells(v.raw(), 0.01, least=CELL).withColumn("movers", F.round(F.col("move_rate") * F.col("n")).cast("long"))
    return fits.with_arrival(cells.withColumn("s", 2.0 + F.col("qi") / 4), 0.01, 25).select("qi", "tj", "movers", "size", "nu")


def _endgame(v: View) -> DataFrame:
    return fits.endgame_fits(v.raw(), 0.01, least=CELL, movers=10)


def _tick_segments(v: View) -> DataFrame:
    return panel.segments(v.markets(), 0.05, 0.95, 1.0, least=5, unit=0.01)


def _cell_scores(v: View) -> DataFrame:
    return forecasts.cell_scores(v.markets(), 0.01, _cells(v), regimes.cell_variances(v.raw(), 0.01))


#: Two sets of GARCH parameters, to test the recurrence in both engines.
GARCH = [(0.0004, 0.1, 0.6), (0.002, 0.3, 0.3)]


def _race(v: View) -> DataFrame:
    return forecasts.race(v.markets(), panel.folds(v.catalog()).withColumn("fold", F.col("fold").cast("int")), 0.01, segment=5, least=CELL, fit_least=FIT, mixture_least=100)


def _mixture(v: View) -> DataFrame:
    rows = panel.random_split(markets.standardised(_features(v), list(markets.CLUSTER_FEATURES)))
    return mixtures.held_out(rows, list(markets.CLUSTER_FEATURES), F.col("is_test"))[1]


def _gate(v: View) -> DataFrame:
    sides = _venues(v).select("key", F.lit("category").alias("partition"), F.col("category").alias("part")).unionByName(_clusters(v).select("key", F.lit("cluster").alias("partition"), F.col("cluster").cast("string").alias("part")))
    segs = panel.segments(v.markets(), 0.05, 0.95, 1.0, least=5)
    return states.gate(segs, sides, panel.random_split(v.catalog().select("key")), least=100)


def _clusters(v: View) -> DataFrame:
    return v.catalog().select("key", (F.col("key").cast("long") % 3).alias("cluster"))


def _venues(v: View) -> DataFrame:
    return v.catalog().select("key", F.concat(F.lit("c"), F.col("key").cast("long") % 4).alias("category"))


def _labels(v: View) -> DataFrame:
    c = v.catalog()
    return c.select("key", (F.col("key").cast("long") % 4).alias("a"), (F.col("key").cast("long") % 6).alias("b"))


def _tags(v: View) -> DataFrame:
    rows = v.events.select(F.col("event_id").alias("event"), F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 7)).alias("tags"))
    return rows


QUERIES: dict[str, Callable[[View], DataFrame]] = {
    "a05_catalog_upsert": _catalog_upsert,
    "a07_bars_upsert": _upsert,
    "a08_safe_names": lambda v: v.prices.select("event_type", "user_id").distinct().select("event_type", "user_id", store.safe_name(F.concat("event_type", F.lit("/x y:"), "user_id")).alias("name")),
    "a09_done_set": lambda v: store.done_set(v.catalog().filter("venue = 0"), v.catalog().filter("closed")),
    "a10_select_markets": lambda v: store.select_markets(v.catalog(), True, 100.0, 50).select("key", "volume"),
    "a11_todo": lambda v: store.todo(store.select_markets(v.catalog(), True), v.catalog().filter("venue = 0")).select("key", "volume"),
    "a12_final_markets": lambda v: store.final_markets(v.catalog(), 20).select("key", "volume"),
    "a14_union_catalogs": lambda v: store.union_catalogs(v.catalog().filter("venue = 0").withColumn("volume", F.col("volume") + 5), v.catalog()).select("key", "volume"),
    "a15_series": lambda v: store.with_series(store.market_rows(v.listing2()), v.series()).select("key", "series_ticker", "category", "frequency"),
    "a16_volume_floor": lambda v: store.above_floor(_lines(v), 50.0).select("key", "volume"),
    "a13_long_lived": lambda v: store.long_lived(v.catalog().withColumn("start", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("end", F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), 50.0, 27.5, 1000).select("key", "days"),
    "a17_parse_markets": lambda v: store.parse_markets(v.listing1()),
    "a18_market_rows": lambda v: store.market_rows(v.listing2()),
    "a19_numbers": _numbers,
    "a20_candles": _candles,
    "a21_resample": lambda v: store.resample(v.prices.select("key", F.floor(F.unix_micros("ts") / 1000000).alias("t"), F.col("close").alias("p"), F.col("event_id").alias("seq")), 14400),
    "a22_chunks": lambda v: store.chunks(v.catalog().select("key", F.date_trunc("day", "start").alias("t0"), F.date_trunc("day", "end").alias("t1")), 7),
    "a24_scan_order": lambda v: store.scan_order(v.series(), 6).select("ticker", "rank"),
    "a28_event_tags": lambda v: store.tagged(_tag_objects(v)),
    "a30_alarms": lambda v: store.alarms(v.bars("day"), v.catalog()),
    "a33_top_up": lambda v: store.top_up(store.market_rows(v.listing2()), v.listing2().filter("series_ticker = 'S1'").select(F.col("ticker").alias("key")), 1),
    "a35_backfill_bars": lambda v: backfill.parsed_bars(_attempts(v), 60).select("key", "ts", *store.DOUBLES[:6]),
    "a35_backfill_outcomes": _outcomes,
    "a36_universe": lambda v: backfill.universe(v.listing2(), "tickers", closed=True, volume=50.0, days=20.0),
    "a36_universe_by_outcomes": lambda v: backfill.universe(v.listing1(), "outcomes", closed=False),
    "a37_appended_store": _stored,
    "a31_vintage_diff": lambda v: store.vintage_diff(v.bars("day"), _upsert(v)),
    "a32_violations": lambda v: store.violations(v.bars("day"), v.catalog()),
    "a26_series_markets": lambda v: store.series_markets(_tickers(v), 100.0, 5.0).select("key", "series", "volume"),
    "a38_window_end": lambda v: _spans(v).select("key", "until"),
    "a39_utc": _times,
    "a40_tier": lambda v: _spans(v).select("key", store.tier(F.col("closed"), F.col("until"), F.lit(CUTOFF).cast("timestamp")).alias("tier")),
    "b01_grid": _grid,
    "b07_normal": _normal,
    "c01_markets": lambda v: v.markets(),
    "c02_raw_panel": lambda v: v.raw(),
    "c03_move_panel": lambda v: v.moves().select("key", "ts_days", "p", "dp", "dt", "tau", "v_binom", "v_gauss", "v_wf", "z", "lam"),
    "c04_hourly_pairs": lambda v: panel.hourly_pairs(v.bars("hour")),
    "c05_segments": _segments,
    "c09_start_states": lambda v: panel.start_states(v.markets()),
    "c10_remaining_variance": lambda v: panel.remaining_variance(v.markets(), panel.start_states(v.markets())),
    "c08_subsample": lambda v: panel.subsample(panel.segments(v.markets(), 0.30, 0.85, 1.0), 300).groupBy("key", "run").agg(F.count("*").alias("n")),
    "c12_folds": lambda v: panel.folds(v.catalog(), most_test=7),
    "c13_random_split": lambda v: panel.random_split(v.catalog().select("key")),
    "d01_budget_slope": lambda v: variance.budget_slope(_budgets(v)),
    "d02_lifetime_budget": _budgets,
    "d03_budget_by_bucket": lambda v: variance.budget_by_bucket(_budgets(v)),
    "d04_budget_bootstrap": lambda v: variance.bootstrap(_units(v), ["bucket"]),
    "d05_local_slopes": lambda v: variance.local_slopes(v.moves()),
    "d06_local_ratios": lambda v: cube.local_ratios(cube.moments(v.moves())),
    "d07_clustered_bootstrap": lambda v: variance.bootstrap(_clustered(v), ["bucket"]),
    "d08_power_cells": lambda v: variance.power_cells(v.moves(), least=FIT),
    "d08_power_fit": lambda v: variance.power_fit(cube.power_cells(cube.moments(v.moves()), least=FIT)),
    "d09_power_fit_bulk": lambda v: variance.power_fit(cube.power_cells(cube.within(cube.moments(v.moves()), *regimes.BULK), least=FIT)),
    "d10_kurtosis": lambda v: variance.kurtosis_by_bucket(v.moves()),
    "b13_winsorised": lambda v: variance.winsorised(v.moves()).select("key", "ts_days", "z", "lam"),
    "d11_acf": lambda v: variance.acf(v.moves(), ["z", "lam"]),
    "d12_acf_winsorised": lambda v: variance.acf(variance.winsorised(v.moves()), ["z", "lam"]),
    "d15_ratios_with_floor": lambda v: variance.ratios_with_floor(_units(v), 10, 2000),
    "d17_scalars": lambda v: cube.scalars(_budgets(v), v.moves(), FIT),
    "d18_level_match": lambda v: variance.level_match(variance.rate_by_price(v.moves(), 0.5, CELL), 1.3),
    "d14_rate_by_price": lambda v: variance.rate_by_price(v.moves(), 0.5, CELL),
    "e01_map_cells": _cells,
    "e04_rectangle": lambda v: _listed(regimes.rectangle(_cells(v)), "p_buckets", "tau_bands"),
    "e05_regime_shares": lambda v: regimes.shares(_cells(v)),
    "e08_map_driver": lambda v: _driver(v, v.moves()),
    "e03_regimes": lambda v: _driver(v, v.restless()),
    "e07_pivot": lambda v: regimes.pivoted(_cells(v), "n"),
    "h02_tick_histogram": lambda v: regimes.tick_histogram(regimes.tick_rows(v.raw(), None, 0.01)),
    "h03_tick_masses": _tick_masses,
    "h04_hazard_fits": lambda v: fits.hazard_fits(_histogram(v), 300),
    "h05_hazard_summary": _tick_summary,
    "h07_endgame_fits": _endgame,
    "h08_arrival": _arrival,
    "h14_endgame_laws": lambda v: fits.endgame_laws(_endgame(v)),
    "h06_endgame_cells": lambda v: regimes.endgame_cells(v.raw(), 0.01, least=CELL),
    "h09_wls": lambda v: variance.power_fit(regimes.endgame_cells(v.raw(), 0.01, least=CELL).filter("tot > 0").withColumnRenamed("tot", "my"), least=6),
    "h01_regime_ticks": lambda v: regimes.tick_histogram(regimes.tick_rows(v.raw(), _cells(v).filter("regime = 1 and pi % 2 = 0"), 0.01)),
    "f06_state_fits": lambda v: states.nested(states.fits(panel.segments(v.markets(), 0.05, 0.95, 1.0, least=5), list(states.VARIANTS)), "full"),
    "f07_pit_deciles": lambda v: states.deciles(states.transforms(panel.segments(v.markets(), 0.05, 0.95, 1.0, least=5), STATE).select(F.explode("pit").alias("pit"))),
    "g05_inflated_fits": lambda v: states.nested(states.fits(_tick_segments(v), list(states.INFLATED_VARIANTS)), "zi"),
    "i05_cell_scores": _cell_scores,
    "i03_garch_likelihood": lambda v: forecasts.garch_likelihoods(forecasts.garch_series(v.raw(), []), GARCH, []),
    "i03_garch_fit": lambda v: forecasts.garch_fit(v.raw()),
    "i06_scores": _race,
    "i07_summary": lambda v: forecasts.summary(_cell_scores(v), ("bucket", "flat"), "flat"),
    "i07_by_regime": lambda v: forecasts.by_regime(_cell_scores(v), ("bucket", "flat")),
    "i08_delta_intervals": lambda v: forecasts.delta_intervals(_cell_scores(v), ("bucket", "flat"), "flat", F.col("key").cast("long")),
    "i11_budget_integration": lambda v: forecasts.budget_integration(panel.remaining_variance(v.markets(), panel.start_states(v.markets()))),
    "h10_spend_profile": lambda v: regimes.spend_profile(v.markets(), v.raw()),
    "i02_cell_variances": lambda v: regimes.cell_variances(v.raw(), 0.01),
    "j01_bar_backed": lambda v: matching.bar_backed(v.catalog(), v.bars("day").filter("close > 0.5")).select("key", "volume"),
    "j02_pairs": lambda v: matching.pairs(*v.venues()),
    "j03_aligned": _aligned,
    "j03_aligned_hourly": lambda v: venues.aligned(v.pairs(), v.bars("hour"), "hour", "1 hour"),
    "j04_gap_stats": lambda v: venues.gap_stats(_aligned(v)),
    "j04_gap_by_domain": lambda v: venues.gap_by(_aligned(v), v.pairs(), "domain"),
    "j04_gap_by_quality": lambda v: venues.gap_by(_aligned(v), v.pairs(), "quality"),
    "j06_paired_budget": lambda v: venues.paired_budget(_aligned(v)),
    "j06_paired_summary": lambda v: venues.paired_summary(venues.paired_budget(_aligned(v))),
    "j07_paired_power": lambda v: venues.paired_power(_aligned(v), "p_k"),
    "j07_paired_power_pm": lambda v: venues.paired_power(_aligned(v), "p_pm"),
    "j08_cross_correlation": lambda v: venues.cross_correlation(_aligned(v)),
    "j09_predictive": lambda v: venues.predictive(_aligned(v), "dm", "dk"),
    "k01_fingerprints": _features,
    "k03_standardised": lambda v: markets.standardised(_features(v), list(markets.CLUSTER_FEATURES)),
    "k04_mixtures": _mixture,
    "k05_selection": lambda v: mixtures.select(_features(v).groupBy(F.col("n_moves").cast("int").alias("k")).agg(F.max("lam").alias("heldout_ll")), 0.5),
    "k06_labels": lambda v: mixtures.scored(_features(v), TWO, ["xstill", "lam"]).select("key", "ll", "cluster"),
    "k07_adjusted_rand": lambda v: markets.adjusted_rand(_labels(v), "a", "b"),
    "k08_categories": lambda v: markets.categories(_tags(v)),
    "k09_cluster_cards": lambda v: markets.cluster_cards(_features(v), v.markets(), _clusters(v), _venues(v)),
    "k10_power_by_cluster": lambda v: variance.power_fit(variance.power_cells(v.moves().join(_clusters(v), "key"), ["cluster"], least=5), ["cluster"]),
    "k11_gate": _gate,
    "k12_intraday": lambda v: markets.intraday(panel.hourly_pairs(v.bars("hour"))),
    "k13_signature": lambda v: markets.signature(v.bars("hour"), v.bars("day")),
    "k15_signature_quartiles": lambda v: markets.quartiles(markets.signature(markets.long_enough(v.bars("hour"), 8), v.bars("day")), "signature"),
    "k14_daily_variance": lambda v: markets.daily_variance(v.bars("day")),
    "k16_load_strips": lambda v: markets.load_strips(_tickers(v), v.bars("day").withColumn("key", _ticker()), ["S0", "S2"]),
    "k17_ladder_bins": lambda v: markets.ladder_bins(v.strikes()),
    "k17_strip_bins": lambda v: markets.strip_bins(v.strips()),
    "k19_summary": lambda v: markets.summary(markets.ladder_bins(v.strikes()), "event", "ts", "prob"),
    "k22_claims": lambda v: markets.claims(_fixture(v, QUOTED, "name string, quoted double, tol double"), v.catalog().groupBy(F.concat(F.lit("markets of venue "), "venue").alias("name")).agg(F.count("*").cast("double").alias("value"))),
    "k18_strip_moments": _moments,
    "k20_iv_terms": lambda v: markets.iv_terms(markets.with_iv(_moments(v), KINDS)),
    "k26_iv_summary": lambda v: markets.iv_summary(markets.with_iv(_moments(v), KINDS)),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: rounded(f(View(spark, sf_dir)))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
