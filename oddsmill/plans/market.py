"""The market view over the test tables: events become bars, a catalog, pairs of venues and strike ladders."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.operators import matching, panel


class View:
    """Tables of one data directory, each built on first use; plans only."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        value = F.col("value") / (F.col("value") + F.lit(20.0))
        close = F.least(F.greatest(F.round(value, 2), F.lit(0.01)), F.lit(0.99))
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.prices = self.events.select(F.col("user_id").cast("string").alias("key"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", close.alias("close"), "value")

    def bars(self, unit: str) -> DataFrame:
        """Last price of each key and day or hour."""
        last = self.prices.groupBy("key", "user_id", F.date_trunc(unit, "ts").alias("ts")).agg(F.max_by("close", F.struct(F.col("ts"), F.col("event_id"))).alias("close"))
        return last.withColumn("bid", F.col("close") - 0.01).withColumn("ask", F.col("close") + 0.01)

    def catalog(self) -> DataFrame:
        out = self.prices.groupBy("key", "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("value").alias("volume"))
        return out.select("key", (F.col("user_id") % 2).alias("venue"), "start", "end", (F.col("user_id") % 5 != 4).alias("closed"), (F.col("user_id") % 3 == 0).cast("double").alias("final_price"), F.round("volume", 4).alias("volume"))

    def markets(self) -> DataFrame:
        return panel.load_markets(self.bars("day"), self.catalog())

    def raw(self) -> DataFrame:
        return panel.raw_panel(self.markets())

    def moves(self) -> DataFrame:
        return panel.standardised(panel.move_panel(self.markets()))

    def restless(self) -> DataFrame:
        """Moves of which low prices often skip one and high prices leap now and then, so that every regime occurs."""
        day = F.col("ts_days").cast("long")
        f = F.when((F.col("p") < 0.3) & (day % 3 != 0), 0.0).when(F.col("p") >= 0.7, F.when(day % 13 == 1, 10.0).otherwise(0.1)).otherwise(1.0)
        return self.moves().withColumn("f", f).withColumns({"dp": F.col("dp") * F.col("f"), "z": F.col("z") * F.col("f")}).withColumns({"dp2": F.col("dp") * F.col("dp"), "lam": F.col("z") * F.col("z")}).drop("f")

    def pairs(self) -> DataFrame:
        """User 2i against user 2i + 1."""
        ids = self.prices.select(F.floor(F.col("user_id") / 2).alias("pair_id")).distinct()
        kind = F.concat(F.lit("d"), F.col("pair_id") % 3).alias("domain"), F.when(F.col("pair_id") % 4 == 0, "approx").otherwise("exact").alias("quality")
        return ids.select("pair_id", (2 * F.col("pair_id")).cast("string").alias("k_key"), (2 * F.col("pair_id") + 1).cast("string").alias("pm_key"), *kind)

    def strips(self) -> DataFrame:
        """Strips by event type, day and one of three forms: brackets with tails, ladders, and ladders that are too short."""
        rows = self.prices.select(F.col("event_type").alias("type"), F.date_trunc("day", "ts").alias("ts"), "close").withColumn("form", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("form") == 2, 3).otherwise(9))))
        lo, above = F.col("i") / 10.0, F.when(F.col("close") > F.col("i") / 10.0, 1.0).otherwise(0.0)
        inside = F.when((F.col("close") > lo) & (F.col("close") <= (F.col("i") + 1) / 10.0), 1.0).otherwise(0.0)
        bracket = (F.col("form") == 0) & F.col("i").between(2, 7)
        kind = F.when(bracket, "between").when((F.col("form") == 0) & (F.col("i") < 2), "less").when(F.col("i") % 2 == 0, "greater").otherwise("greater_or_equal")
        price = F.when(bracket, inside).when(kind == "less", 1.0 - above).otherwise(above)
        rows = rows.select(F.concat("type", F.lit("-"), "form").alias("event"), "ts", "type", kind.alias("strike_type"), F.when(kind != "less", lo).alias("fs"), F.when(bracket, (F.col("i") + 1) / 10.0).when(kind == "less", lo).alias("cs"), price.alias("p"))
        return rows.groupBy("event", "ts", "type", "strike_type", "fs", "cs").agg(F.round(F.avg("p"), 4).alias("close"))

    def strip_ends(self) -> DataFrame:
        """Every strip ends with its event's last day; the event type is its series."""
        rows = self.strips()
        last = rows.groupBy("event").agg(F.max("ts").alias("end"))
        return rows.groupBy("event", "ts", F.col("type").alias("series")).agg(F.count("*").alias("n_strikes")).join(last, "event")

    def catalog_texts(self) -> DataFrame:
        """The catalog's markets with their number i (the user), as the venues' texts are made from."""
        return self.prices.groupBy(F.col("user_id").alias("i")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.round(F.sum("value"), 2).alias("v"))

    def listing1(self) -> DataFrame:
        """Venue-1 market objects: outcomes in either order, categorical, malformed, unequal and empty ones among them."""
        i, text = F.col("i"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        names = F.when(i % 7 == 0, '["Alpha", "Beta"]').when(i % 7 == 1, '["No", "YES"]').when(i % 7 == 2, '["Yes", "No"').otherwise('["Yes", "No"]')
        tokens = F.when(i % 11 == 3, F.format_string('["%d"]', i)).when(i % 11 == 4, '["", ""]').otherwise(F.format_string('["7%d", "8%d"]', i, i))
        prices = F.when(i % 5 == 0, '["1", "0"]').when(i % 5 == 1, '["0.003", "0.997"]').when(i % 5 == 2, '["0.4", "0.6"]').when(i % 5 == 3, '["x", "0"]')
        events = F.when(i % 3 == 0, F.format_string('[{"id": "e%d", "slug": "s%d"}, {"id": "other"}]', i, i)).when(i % 3 == 1, "[]")
        return self.catalog_texts().select(
            F.concat(F.lit("Q"), i).alias("question"), names.alias("outcomes"), tokens.alias("clobTokenIds"), prices.alias("outcomePrices"), text("t0").alias("startDate"), F.when(i % 4 != 0, text("t1")).alias("endDate"),
            F.when(i % 6 != 5, i % 6 != 0).alias("closed"), F.when(i % 3 == 0, F.col("v").cast("string")).when(i % 3 == 1, "0").alias("volumeNum"), (F.col("v") + 1).cast("string").alias("volume"),
            F.concat(F.lit("0x"), i).alias("conditionId"), F.concat(F.lit("q-"), i).alias("slug"), events.alias("events"), (i % 2 == 0).alias("negRisk"), i.cast("string").alias("id"),
        )

    def listing2(self) -> DataFrame:
        """Venue-2 market objects, their volumes in three generations."""
        i, text = F.col("i"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return self.catalog_texts().select(
            F.concat(F.lit("S"), i % 5, F.lit("-"), i).alias("ticker"), F.concat(F.lit("T"), i).alias("title"), text("t0").alias("open_time"), F.when(i % 4 != 0, text("t1")).alias("close_time"),
            F.when(i % 5 == 0, "Yes").when(i % 5 == 1, "no").when(i % 5 == 2, "").alias("result"), F.when(i % 3 == 0, "Active").when(i % 3 == 1, "settled").alias("status"),
            F.when(i % 3 == 0, F.col("v").cast("string")).when(i % 3 == 1, "bad").alias("volume_fp"), F.floor("v").cast("string").alias("volume"), F.lit(None).cast("string").alias("open_interest_fp"), F.when(i % 2 == 0, (i * 3).cast("string")).alias("open_interest"),
            F.concat(F.lit("S"), i % 5).alias("series_ticker"), F.concat(F.lit("E"), i % 9).alias("event_ticker"), (i % 11).cast("double").alias("floor_strike"), F.lit(None).cast("double").alias("cap_strike"), F.lit("greater").alias("strike_type"),
            F.when(i % 3 == 0, text("t1")).alias("settlement_ts"),
        )

    def payloads(self) -> DataFrame:
        """Raw replies of both venues, a page for each key and day: candles of some keys (cents or dollars, without trades in every third hour), price points of others; broken and unknown pages among them, none of some keys."""
        i, cents, hour = F.col("user_id"), F.round(F.col("close") * 100).cast("long"), F.floor(F.unix_micros("ts") / 3600000000)
        old = lambda x: F.when((i % 8 == 0) & (hour % 3 != 0), x)
        new = lambda x: F.when((i % 8 != 0) & (hour % 3 != 0), (x / 100).cast("string"))
        price = F.struct(*(f(x).alias(n + end) for f, end in ((old, ""), (new, "_dollars")) for n, x in (("open", cents), ("high", cents + 1), ("low", cents - 1), ("close", cents))))
        candle = F.struct((hour * 3600).alias("end_period_ts"), price.alias("price"), F.struct((cents - 1).alias("close")).alias("yes_bid"), F.struct((cents + 1).alias("close")).alias("yes_ask"))
        day = F.date_trunc("day", "ts").alias("day")
        page = lambda rows, name, item: rows.groupBy("user_id", day).agg(F.to_json(F.struct(F.collect_list(item).alias(name))).alias("body"))
        candles = page(self.bars("hour").filter("user_id % 4 = 0"), "candlesticks", candle).withColumn("kind", F.lit("candles"))
        points = page(self.prices.filter("user_id % 4 <> 0"), "history", F.struct(F.floor(F.unix_micros("ts") / 1000000).alias("t"), F.col("close").alias("p"))).withColumn("kind", F.lit("points"))
        rows = candles.unionByName(points).filter("user_id % 10 <> 7")
        body = F.when((i % 10 == 3) & (F.dayofmonth("day") % 7 == 0), '{"history": [').otherwise(F.col("body"))
        return rows.select(i.cast("string").alias("key"), F.when(i % 10 == 5, "ticks").otherwise(F.col("kind")).alias("kind"), body.alias("body"))

    def series(self) -> DataFrame:
        """Four of five series, by name."""
        i = F.col("i")
        rows = self.catalog_texts().filter("i < 12")
        names = ["annual", "hourly", "weekly", "monthly", "one_off", "unknown"]
        freq = F.when(i % 7 != 6, F.get(F.array(*map(F.lit, names)), (i % 7).cast("int")))
        return rows.select(F.concat(F.lit("S"), i).alias("ticker"), F.concat(F.lit("c"), i % 3).alias("category"), freq.alias("frequency"), F.when(i % 4 != 0, F.date_format("t1", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("last_updated_ts")).filter("ticker <> 'S4'")

    def venues(self) -> tuple[DataFrame, DataFrame]:
        """Catalogs of both venues, whose texts the matching rules read: each user is a market of either."""
        i, m = F.col("i"), (F.col("i") % 12).cast("int")
        names = F.array(*map(F.lit, matching.MONTHS))
        short = F.array(*map(F.lit, matching.MONTHS.values()))
        hand = lambda k: F.get(F.array(*(F.lit(x[k]) for x in matching.BY_HAND)), F.floor(i / 5).cast("int") % 7)
        rows = self.catalog_texts().withColumns({"kind": i % 5, "year": F.lit(25)})
        bucket = F.get(F.array(*map(F.lit, ("H0", "C25", "C26", "H25"))), (F.floor(i / 60) % 4).cast("int"))
        said = F.get(F.array(*map(F.lit, ("No change in Fed interest rates after %s 2025 meeting?", "Fed decreases interest rates by 25 bps after %s meeting?", "Fed decreases interest rates by 50+ bps after %s 2025 meeting?", "Fed increases interest rates by 25+ bps after %s 2025 meeting?"))), (F.floor(i / 60) % 4).cast("int"))
        strike = (F.floor(i / 5) % 4 + 9) * 10
        end = F.to_timestamp(F.lit("2025-12-31 00:00:00"))
        k = rows.select(
            F.when(i % 5 == 0, F.concat(F.lit("KXFEDDECISION-25"), F.get(short, m), F.lit("-"), bucket)).when(i % 5 == 1, F.concat(F.lit("NOM-"), i)).when(i % 5 == 2, F.concat(F.lit("KXBTCMAXMON-BTC-25"), F.get(short, m), F.lit("31-"), strike * 1000)).when(i % 5 == 3, F.concat(F.lit("KXBTCMAXY-25-DEC31-"), i)).otherwise(hand(1)).alias("key"),
            F.when(i % 5 == 0, "KXFEDDECISION").when(i % 5 == 1, "KXFEDCHAIRNOM").when(i % 5 == 2, "KXBTCMAXMON").when(i % 5 == 3, "KXBTCMAXY").otherwise("OTHER").alias("series_ticker"),
            F.concat(F.lit("Will they nominate Person "), F.floor(i / 10), F.lit(" as Fed Chair?")).alias("question"), (strike * 1000 - 0.01).alias("floor_strike"), F.col("v").alias("volume"),
        )
        question = (
            F.when(i % 5 == 0, F.regexp_replace(said, "%s", F.initcap(F.get(names, m)))).when(i % 5 == 1, F.concat(F.lit("Will Trump nominate Person "), F.floor(i / 10), F.lit(" as the next Fed chair?")))
            .when((i % 5 == 2) & (i % 2 == 0), F.concat(F.lit("Will Bitcoin reach $"), strike, F.lit("k in "), F.initcap(F.get(names, m)), F.lit("?")))
            .when(i % 5 == 2, F.concat(F.lit("Will Bitcoin reach $"), strike, F.lit(",000 in "), F.initcap(F.get(names, m)), F.lit("?")))
            .when(i % 5 == 3, F.concat(F.lit("Will Bitcoin reach $"), strike, F.lit(",000 by December 31, 2025?"))).otherwise(hand(2))
        )
        slug = F.when(i % 5 == 0, "fed-decision-in-some-month").when(i % 5 == 1, "who-will-trump-nominate-as-fed-chair")
        p = rows.select(F.concat(F.lit("p"), i).alias("key"), question.alias("question"), slug.alias("event_slug"), end.alias("end"), (F.col("v") + i % 3).alias("volume"))
        return k.groupBy("key", "series_ticker").agg(F.min("question").alias("question"), F.min("floor_strike").alias("floor_strike"), F.max("volume").alias("volume")), p

    def strikes(self) -> DataFrame:
        """A ladder for each event type and day: strikes 0.1 to 0.9, priced by the share of closes above them."""
        rows = self.prices.select(F.col("event_type").alias("event"), F.date_trunc("day", "ts").alias("ts"), "close")
        rows = rows.withColumn("k", F.explode(F.array(*(F.lit(i / 10) for i in range(1, 10)))))
        return rows.groupBy("event", "ts", "k").agg(F.avg((F.col("close") > F.col("k")).cast("double")).alias("p"))
