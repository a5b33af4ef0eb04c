"""The catalog and bars store: partitioned Parquet, keep-last upserts, selections, views and constraint checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

DOUBLES = ("open", "high", "low", "close", "bid", "ask", "volume", "open_interest")
BARS = T.StructType([T.StructField(c, T.StringType()) for c in ("venue", "freq", "key")] + [T.StructField("ts", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in DOUBLES])
CATALOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("venue", "key", "question")]
    + [T.StructField(c, T.TimestampType()) for c in ("start", "end")]
    + [T.StructField("closed", T.BooleanType()), T.StructField("final_price", T.DoubleType()), T.StructField("volume", T.DoubleType())]
)


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns first, in its types: what cannot be cast, NaN included, becomes null; extras follow."""
    def one(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        c = c.try_cast(f.dataType) if df.schema[f.name].dataType == T.StringType() else c.cast(f.dataType)
        return (F.nanvl(c, F.lit(None)) if f.dataType == T.DoubleType() else c).alias(f.name)

    return df.select(*map(one, schema), *(c for c in df.columns if c not in schema.names))


def latest(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Union by name, a row for each key: of the new rows, or with keep='first' of the old ones, where both have it."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    order = F.col("_gen").desc() if keep == "last" else F.col("_gen").asc()
    w = Window.partitionBy(*keys).orderBy(order, *(F.col(c).asc_nulls_last() for c in old.columns if c not in keys))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_gen")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path with the schema's columns at least; an empty one where there is none."""
    try:
        return coerced(spark.read.option("mergeSchema", "true").parquet(path), schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def upsert_bars(spark: SparkSession, path: str, new: DataFrame, staging: str) -> DataFrame:
    """Merge bars into the store: only the (venue, freq) partitions that new rows touch are rewritten, by way of staging."""
    new = coerced(new, BARS)
    touched = new.select("venue", "freq").distinct()
    old = read(spark, path, BARS).join(F.broadcast(touched), ["venue", "freq"], "left_semi")
    latest(old, new, ["venue", "freq", "key", "ts"]).select(*BARS.names).write.mode("overwrite").partitionBy("venue", "freq").parquet(staging)
    merged = coerced(spark.read.parquet(staging), BARS)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("venue", "freq").parquet(path)
    return merged


def register_views(spark: SparkSession, bars: str, catalog: str) -> None:
    """Temporary views `bars` and `catalog`, typed and empty where nothing has been written."""
    read(spark, bars, BARS).createOrReplaceTempView("bars")
    read(spark, catalog, CATALOG).createOrReplaceTempView("catalog")


def safe_name(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9._-]", "_")


def select_markets(catalog: DataFrame, only_closed: bool = False, least_volume: float | None = None, limit: int | None = None) -> DataFrame:
    rows = catalog.filter(F.coalesce("closed", F.lit(False))) if only_closed else catalog
    if least_volume is not None:
        rows = rows.filter(F.col("volume") >= least_volume)
    rows = rows.orderBy(F.col("volume").desc_nulls_last(), "key")
    return rows.limit(limit) if limit else rows


def long_lived(catalog: DataFrame, least_volume: float, least_days: float, limit: int) -> DataFrame:
    """Markets by lifetime and volume; start and end are ISO 8601 strings of either precision."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c)))
    rows = catalog.withColumn("days", (at("end") - at("start")) / 86400e6)
    return rows.filter((F.col("volume") >= least_volume) & (F.col("days") >= least_days)).orderBy(F.desc("volume"), "key").limit(limit)


def todo(selected: DataFrame, done: DataFrame) -> DataFrame:
    return selected.join(done.select("key"), "key", "left_anti")


def chunks(spans: DataFrame, step_days: int) -> DataFrame:
    """Windows of a fixed length that cover [t0, t1) of each key, the last one cut."""
    step = F.expr(f"INTERVAL {step_days} DAYS")
    rows = spans.filter("t0 < t1").withColumn("from", F.explode(F.sequence("t0", F.col("t1") - F.expr("INTERVAL 1 MICROSECOND"), step)))
    return rows.select("key", "from", F.least(F.col("from") + step, F.col("t1")).alias("to"))


def vintage_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest differences of closes per key that two vintages share, as median, 95th percentile and maximum."""
    met = a.select("key", "ts", F.col("close").alias("x")).join(b.select("key", "ts", F.col("close").alias("y")), ["key", "ts"])
    d = met.groupBy("key").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("d"))
    return d.agg(F.count("*").alias("keys"), F.median("d").alias("p50"), F.percentile("d", F.lit(0.95)).alias("p95"), F.max("d").alias("most"))


def violations(bars: DataFrame, catalog: DataFrame) -> DataFrame:
    """Number of closes out of [0, 1], of finals that are neither 0 nor 1, and the median of the keys' largest closes."""
    top = bars.groupBy("key").agg(F.max("close").alias("top"), F.sum((~F.col("close").between(0, 1)).cast("long")).alias("out"))
    row = top.agg(F.sum("out").alias("out_of_range"), F.median("top").alias("median_top"))
    finals = catalog.agg(F.sum((F.col("final_price").isNotNull() & ~F.col("final_price").isin(0.0, 1.0)).cast("long")).alias("bad_finals"))
    return row.join(F.broadcast(finals))  # one row each


EVENTS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "slug")]))


def parse_markets(raw: DataFrame) -> DataFrame:
    """Venue-1 markets of their JSON fields (strings; closed and negRisk boolean): outcomes, prices and token ids are JSON arrays within strings.

    The tracked outcome is "yes" in any case, else the first; its token is the key. A price counts as final within
    0.005 of 0 or 1, of closed markets. volumeNum counts where it is there and not 0, else volume; of the events the
    first. Rows with malformed or unequal lists or without a key are dropped; missing fields are null.
    """
    fields = ("outcomes", "outcomePrices", "clobTokenIds", "question", "startDate", "endDate", "volumeNum", "volume", "conditionId", "slug", "events", "id")
    raw = raw.select(*(F.col(c).cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in fields), *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) if c in raw.columns else F.lit(False).alias(c) for c in ("closed", "negRisk")))
    lists = {c: F.from_json(F.col(c), T.ArrayType(T.StringType())) for c in ("outcomes", "outcomePrices", "clobTokenIds")}
    rows = raw.withColumns({f"_{c}": v for c, v in lists.items()}).filter((F.size("_outcomes") > 0) & (F.size("_outcomes") == F.size("_clobTokenIds")))
    yes = F.array_position(F.transform("_outcomes", F.lower), "yes")
    at = F.when(yes > 0, yes).otherwise(1).cast("int")
    price = F.try_element_at("_outcomePrices", at).try_cast("double")
    final = F.when(F.col("closed") & (price <= 0.005), 0.0).when(F.col("closed") & (price >= 0.995), 1.0)
    event = F.try_element_at(F.from_json("events", EVENTS), F.lit(1))
    volume = F.coalesce(F.nullif(F.col("volumeNum").try_cast("double"), F.lit(0.0)), F.col("volume").try_cast("double"))
    out = rows.select(
        F.element_at("_clobTokenIds", at).alias("key"), F.element_at("_outcomes", at).alias("outcome"), "question", utc(F.col("startDate")).alias("start"), utc(F.col("endDate")).alias("end"),
        "closed", final.alias("final_price"), volume.alias("volume"), F.col("conditionId").alias("condition_id"), "slug", event.id.alias("event_id"), event.slug.alias("event_slug"),
        F.col("negRisk").alias("neg_risk"), F.col("id").alias("gamma_id"),
    )
    return out.filter("key <> ''")


def market_rows(raw: DataFrame) -> DataFrame:
    """Venue-2 markets: the result gives the final price, a final status or a result closes; the volume comes in three generations."""
    result, status = F.lower(F.coalesce("result", F.lit(""))), F.lower(F.coalesce("status", F.lit("")))
    final = F.when(result == "yes", 1.0).when(result == "no", 0.0)
    numbers = {c: number(F.lit(None).cast("string"), F.col(f"{c}_fp"), F.col(c), F.lit(False), False) for c in ("volume", "open_interest")}
    return raw.select(
        F.col("ticker").alias("key"), F.col("title").alias("question"), utc(F.col("open_time")).alias("start"), utc(F.col("close_time")).alias("end"),
        (status.isin("settled", "finalized", "closed") | final.isNotNull()).alias("closed"), final.alias("final_price"), numbers["volume"].alias("volume"),
        "series_ticker", "event_ticker", status.alias("status"), F.nullif(result, F.lit("")).alias("result"), "floor_strike", "cap_strike", "strike_type",
        numbers["open_interest"].alias("open_interest"), utc(F.col("settlement_ts")).alias("settlement_ts"),
    )


def with_series(markets: DataFrame, series: DataFrame) -> DataFrame:
    """markets with category and frequency of their series (ticker, category, frequency); null where it is not listed. Of a series listed twice the last by category and frequency counts."""
    known = series.groupBy(F.col("ticker").alias("series_ticker")).agg(F.max(F.struct("category", "frequency")).alias("s"))
    return markets.join(known.select("series_ticker", "s.*"), "series_ticker", "left")


# Frequencies in the order in which series are scanned.
FREQUENCIES = ("annual", "quarterly", "monthly", "weekly", "one_off", "custom", "daily", "hourly", "fifteen_min")


def scan_order(series: DataFrame, limit: int | None = None) -> DataFrame:
    """Series (ticker, frequency, last_updated_ts) with long frequencies first (unknown ones as one_off), then the latest, then by ticker."""
    rank = F.coalesce(*(F.when(F.col("frequency") == f, k) for k, f in enumerate(FREQUENCIES)), F.lit(FREQUENCIES.index("one_off")))
    rows = series.withColumn("rank", rank).orderBy("rank", F.coalesce("last_updated_ts", F.lit("")).desc(), "ticker")
    return rows.limit(limit) if limit else rows


def union_catalogs(listed: DataFrame, swept: DataFrame) -> DataFrame:
    """Per-series rows and those of the global sweep; of equal keys the per-series one stays."""
    return latest(listed, swept, ["key"], keep="first")


def above_floor(lines: DataFrame, least: float) -> DataFrame:
    """Rows of JSON lines (value) of at least a volume, as (key, volume, json); blank and malformed lines and missing volumes go."""
    one = F.from_json("value", "ticker string, volume double")
    rows = lines.select(one.ticker.alias("key"), one.volume.alias("volume"), F.col("value").alias("json"))
    return rows.filter((F.col("volume") >= least) & F.col("key").isNotNull())


def tagged(events: DataFrame) -> DataFrame:
    """(event_id, tags: JSON list of the labels, in order, without empty ones) of event objects' JSON (event_id, json); malformed ones have none."""
    labels = F.transform(F.from_json("json", "tags array<struct<label: string>>").tags, lambda t: t.label)
    return events.select("event_id", F.to_json(F.coalesce(F.filter(labels, lambda x: x != ""), F.array().cast("array<string>"))).alias("tags"))


def done_set(done: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that are done, old and new, once each."""
    return done.select("key").unionByName(new.select("key")).distinct()


def top_up(markets: DataFrame, done: DataFrame, days: int) -> DataFrame:
    """(key, from, to) of the hourly bars still wanted: from the start (rows without one are left out) to `days` after the later of end and settlement."""
    until = F.greatest("end", "settlement_ts") + F.expr(f"INTERVAL {days} DAYS")
    return todo(markets.filter("start is not null"), done).select("key", F.col("start").alias("from"), until.alias("to"))


def final_markets(catalog: DataFrame, limit: int) -> DataFrame:
    """Venue-1 selection: closed markets with a final price, the largest by volume."""
    return select_markets(catalog.filter("final_price is not null"), True, None, limit)


def legacy_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of files <venue>/<freq>/<key>.parquet, with venue, freq and key from their names; columns of different files are united by name."""
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/([^/]+)\.parquet$", k)
    return coerced(rows.withColumns({"venue": part(1), "freq": part(2), "key": part(3)}), BARS)


def alarms(bars: DataFrame, catalog: DataFrame, low: float = 0.2) -> DataFrame:
    """violations() with scale_alarm: the median of the keys' largest closes is so low that prices must be out of scale."""
    return violations(bars, catalog).withColumn("scale_alarm", F.coalesce(F.col("median_top") < low, F.lit(False)))


def write_results(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each table as a folder of CSV (with header), JSON lines or Parquet."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(f"{path.rstrip('/')}/{name}")


def number(dollars: Column, fp: Column, legacy: Column, legacy_is_string: Column, cents: bool) -> Column:
    """The first generation that is present wins, even if it cannot be parsed; legacy integers are cents, strings dollars."""
    old = legacy.try_cast("double")
    old = F.when(legacy_is_string, old).otherwise(old / 100) if cents else old
    return F.when(dollars.isNotNull(), dollars.try_cast("double")).when(fp.isNotNull(), fp.try_cast("double")).otherwise(old)


def candles(raw: DataFrame) -> DataFrame:
    """Bars of venue-2 candles (end, open, high, low, close, bid, ask; volume and open_interest if there): the midpoint stands in for a candle without trades."""
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = raw.withColumns({c: F.when(F.col("close").isNull(), mid).otherwise(F.col(c)) for c in ("open", "high", "low")} | {"close": F.coalesce("close", mid)})
    return rows.filter("close is not null").select("key", F.timestamp_seconds("end").alias("ts"), "open", "high", "low", "close", "bid", "ask", *(c for c in ("volume", "open_interest") if c in raw.columns))


def resample(points: DataFrame, seconds: int) -> DataFrame:
    """Bars of price points (key, t: epoch seconds, p), labelled by and including their right end; of equal times the first stays."""
    w = Window.partitionBy("key", "t").orderBy("seq")
    rows = points.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    end = F.ceil(F.col("t") / seconds) * seconds
    out = rows.groupBy("key", end.alias("end")).agg(F.min_by("p", "t").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "t").alias("close"))
    return out.select("key", F.timestamp_seconds("end").alias("ts"), "open", "high", "low", "close")


def utc(text: Column) -> Column:
    """Timestamp of ISO 8601 text; text without a zone is in UTC; empty or malformed text gives null."""
    s = F.trim(text)
    return F.try_to_timestamp(F.when(s.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & s.contains(":"), s).when(s != "", F.concat(s, F.when(s.contains(":"), "Z").otherwise("T00:00:00Z"))))


def window_end(end: Column, settlement: Column) -> Column:
    """End of the span for which bars are wanted: a day after the later of end and settlement (either may be null)."""
    return F.greatest(end, settlement) + F.expr("INTERVAL 1 DAY")


def tier(closed: Column, until: Column, cutoff: Column) -> Column:
    """Which archive is asked first: historical for closed markets that end before the cutoff; live otherwise and without a cutoff."""
    return F.when(F.coalesce(closed & (until < cutoff), F.lit(False)), "historical").otherwise("live")


def series_markets(catalog: DataFrame, volume: float, days: float) -> DataFrame:
    """Markets of a volume and lifetime at least, with series: what precedes the first dash of their ticker (key)."""
    life = (F.unix_micros("end") - F.unix_micros("start")) / 86400e6
    return catalog.filter((F.col("volume") >= volume) & (life >= days)).withColumn("series", F.substring_index("key", "-", 1))
