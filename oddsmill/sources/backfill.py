"""Backfill as a batch job: listings become the catalog, raw payloads become bars, finished keys or dead letters."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.sources.appended import Store
from oddsmill.sources.store import candles, market_rows, number, parse_markets, resample, todo

#: The fields of a candle and of a price point, and the minutes of a bar by its name.
CANDLES = "candlesticks array<struct<end_period_ts: bigint, price: string, yes_bid: string, yes_ask: string, volume: string, volume_fp: string, open_interest: string, open_interest_fp: string>>, broken string"
POINTS = "history array<struct<t: bigint, p: string>>, broken string"
MINUTES = {"1m": 1, "1h": 60, "1d": 1440}


def _read(body: Column, schema: str) -> Column:
    return F.from_json(body, schema, {"columnNameOfCorruptRecord": "broken"})


def _dollars(side: Column, name: str) -> Column:
    """A price in a candle's side (JSON): the newer fields first; of the oldest, strings are dollars and numbers cents."""
    old = F.get_json_object(side, f"$.{name}")
    return number(F.get_json_object(side, f"$.{name}_dollars"), F.get_json_object(side, f"$.{name}_fp"), old, side.rlike(f'"{name}"\\s*:\\s*"'), True)


def attempts(markets: DataFrame, payloads: DataFrame, done: DataFrame) -> DataFrame:
    """One row for each payload of a market still to do, with what came of it.

    markets: key, closed. payloads: key, kind ('candles' or 'points'), body (JSON); a market may have several. done: key.
    Returns (key, closed, kind, items: how many bars or points the body holds, body, error). A market without a payload has the error
    'no payload', a null kind or one that is unknown 'unknown kind', a body that isn't the JSON of its kind 'malformed'.
    Rows of markets with a null key match nothing. Of a market listed twice one row stays, closed if either is.
    """
    wanted = todo(markets.groupBy("key").agg(F.max(F.coalesce("closed", F.lit(False))).alias("closed")), done)
    rows = wanted.join(payloads.select("key", "kind", "body", F.lit(True).alias("_came")), "key", "left")
    kind = F.col("kind")
    read = {k: _read(F.col("body"), schema) for k, schema in (("candles", CANDLES), ("points", POINTS))}
    sizes = {k: F.when(j.isNotNull() & j.broken.isNull(), F.coalesce(F.size(F.coalesce(j[f], F.array())), F.lit(0))) for (k, j), f in zip(read.items(), ("candlesticks", "history"), strict=True)}
    rows = rows.withColumn("items", F.when(kind == "candles", sizes["candles"]).when(kind == "points", sizes["points"]).cast("long"))
    known = F.coalesce(kind.isin("candles", "points"), F.lit(False))
    error = F.when(F.col("_came").isNull(), "no payload").when(~known, "unknown kind").when(F.col("items").isNull(), "malformed")
    return rows.select("key", "closed", "kind", "items", "body", error.alias("error"))


def parsed_bars(tried: DataFrame, minutes: int) -> DataFrame:
    """Bars (key, ts, open, high, low, close, bid, ask, volume, open_interest) of the attempts without error; what two payloads share counts once.

    Candles and points of equal time are told apart by their values alone: the smallest stays, so that reruns agree.
    Items without a time or a price that can be read are left out.
    """
    good = tried.filter("error is null")
    c = good.filter("kind = 'candles'").select("key", F.explode(_read(F.col("body"), CANDLES).candlesticks).alias("c"))
    sides = {"bid": _dollars(F.col("c.yes_bid"), "close"), "ask": _dollars(F.col("c.yes_ask"), "close")}
    prices = {n: _dollars(F.col("c.price"), n) for n in ("open", "high", "low", "close")}
    sizes = {n: number(F.lit(None).cast("string"), F.col(f"c.{n}_fp"), F.col(f"c.{n}"), F.lit(False), False) for n in ("volume", "open_interest")}
    c = c.select("key", F.col("c.end_period_ts").alias("end"), *(F.nanvl(x, F.lit(None)).alias(n) for n, x in (prices | sides | sizes).items())).filter("end is not null")
    p = good.filter("kind = 'points'").select("key", F.explode(_read(F.col("body"), POINTS).history).alias("q")).select("key", F.col("q.t").alias("t"), F.col("q.p").try_cast("double").alias("p"))
    p = p.filter("t is not null and p is not null and not isnan(p)").withColumn("seq", F.col("p"))
    both = candles(c).unionByName(resample(p, 60 * minutes), allowMissingColumns=True)
    rest = [x for x in both.columns if x not in ("key", "ts")]
    first = both.groupBy("key", "ts").agg(F.min(F.struct(*(F.struct(F.col(x).isNull().alias("none"), F.col(x).alias("value")).alias(x) for x in rest))).alias("b"))
    return first.select("key", "ts", *(F.col("b")[x]["value"].alias(x) for x in rest))


def outcomes(tried: DataFrame, bars: DataFrame, letters: DataFrame) -> DataFrame:
    """What became of each market tried: (key, n_bars, status, error, attempts).

    'failed' if any of its payloads did, with the smallest error; 'done' if it is closed and has bars; else 'open', to be
    tried again. attempts counts failures with those that letters (key, attempts) already hold; it is 0 after a success.
    """
    counts = bars.groupBy("key").agg(F.count("*").alias("n"))
    one = tried.groupBy("key").agg(F.max("closed").alias("closed"), F.min("error").alias("error")).join(counts, "key", "left").join(letters.select("key", F.col("attempts").alias("before")), "key", "left")
    n, failed = F.coalesce("n", F.lit(0)), F.col("error").isNotNull()
    status = F.when(failed, "failed").when(F.col("closed") & (n > 0), "done").otherwise("open")
    return one.select("key", n.alias("n_bars"), status.alias("status"), "error", F.when(failed, F.coalesce("before", F.lit(0)) + 1).otherwise(0).cast("long").alias("attempts"))


def backfill(store: Store, venue: str, freq: str, markets: DataFrame, payloads: DataFrame, phase: str | None = None) -> int:
    """Try every market of (venue, freq) that isn't done, and commit bars, finished keys and dead letters together.

    Bars of a market's good payloads are kept even if another of its payloads failed. A market that fails is a dead letter
    until an attempt succeeds, which overwrites it with a null error. The attempts are written once, beside the tables,
    as three results are taken from them.
    """
    here = (F.col("venue") == venue) & (F.col("freq") == freq)
    spark, path = store.spark, f"{store.path}/attempts/{uuid.uuid4().hex}"
    attempts(markets, payloads, store.read("done").filter(here)).write.parquet(path)
    tried = spark.read.parquet(path)
    bars = parsed_bars(tried, MINUTES[freq])
    letters = store.read("dead_letters").filter(here)
    came = outcomes(tried, bars, letters)
    marked = lambda df: df.withColumns({"venue": F.lit(venue), "freq": F.lit(freq)})
    known = letters.filter("error is not null").select("key")
    fixed = came.filter("error is null").join(known, "key", "left_semi")
    return store.commit(
        {
            "bars": marked(bars),
            "done": marked(came.filter("status = 'done'")),
            "dead_letters": marked(came.filter("error is not null").unionByName(fixed)),
        },
        phase,
    )


def update(store: Store, payloads: DataFrame) -> None:
    """Try all markets again that aren't closed, of every venue in the catalog and every frequency; payloads has venue and freq."""
    catalog = store.read("catalog")
    for (venue,) in sorted(catalog.select("venue").distinct().collect()):  # a row a venue
        live = catalog.filter((F.col("venue") == venue) & ~F.coalesce("closed", F.lit(False)))
        for freq in MINUTES:
            backfill(store, venue, freq, live, payloads.filter((F.col("venue") == venue) & (F.col("freq") == freq)))


def universe(raw: DataFrame, kind: str, closed: bool | None = None, status: str | None = None, volume: float | None = None, days: float | None = None) -> DataFrame:
    """Catalog rows of market objects: kind 'outcomes' is venue 1's form, 'tickers' venue 2's.

    closed, status (venue 2's, lower-case), the least volume and the least life in days select; None takes all. Of a key listed twice
    the largest volume stays. Markets without a volume or life fall to a floor; without a floor they stay.
    """
    if kind not in ("outcomes", "tickers"):
        raise ValueError(f"no such kind of listing: {kind!r}")
    rows = (parse_markets if kind == "outcomes" else market_rows)(raw)
    if status is not None:
        rows = rows.filter(F.col("status") == status) if kind == "tickers" else rows.filter("false")
    if closed is not None:
        rows = rows.filter(F.coalesce("closed", F.lit(False)) == closed)
    if volume is not None:
        rows = rows.filter(F.col("volume") >= volume)
    if days is not None:
        rows = rows.filter((F.unix_micros("end") - F.unix_micros("start")) / 86400e6 >= days)
    names = ("question", "start", "end", "closed", "final_price", "volume")
    best = rows.filter("key is not null").groupBy("key").agg(F.max(F.struct(F.coalesce("volume", F.lit(float("-inf"))).alias("v"), *names)).alias("m"))
    return best.select("key", *(F.col("m")[c].alias(c) for c in names))
