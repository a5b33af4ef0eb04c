"""Pairs of markets of two venues on the same event, by rules; each rule is an equi-join on what its texts name."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month names and what tickers call them; texts that name a market's meeting, candidate and strike.
MONTHS = {
    "january": "JAN", "february": "FEB", "march": "MAR", "april": "APR", "may": "MAY", "june": "JUN",
    "july": "JUL", "august": "AUG", "september": "SEP", "october": "OCT", "november": "NOV", "december": "DEC",
}
MONTHLY = r"^Will Bitcoin reach \$([\d,]+)(k?) in (\w+)\?"
YEARLY = r"^Will Bitcoin reach \$([\d,]+) by December 31, 2025\?"
#: Markets of either side whose pairs arise together.
BLOCK = 512
# Pairs matched by hand (unit, venue-2 key, venue-1 question, quality).
BY_HAND = (
    ("PRES24-Harris", "PRES-2024-KH", "Will Kamala Harris win the 2024 US Presidential Election?", "exact"),
    ("PRES24-Trump", "PRES-2024-DJT", "Will Donald Trump win the 2024 US Presidential Election?", "exact"),
    ("POPVOTE24-D", "POPVOTE-24-D", "Kamala Harris wins the popular vote?", "exact"),
    ("POPVOTE24-R", "POPVOTE-24-R", "Will Donald Trump win the popular vote in the 2024 Presidential Election?", "exact"),
    ("NYC25-Mamdani/D", "KXMAYORNYCPARTY-25-D", "Will Zohran Mamdani win the 2025 NYC mayoral election?", "approx"),
    ("NYC25-Cuomo", "KXMAYORNYCPARTY-25-AC", "Will Andrew Cuomo win the 2025 NYC mayoral election?", "approx"),
    ("NYC25-Sliwa/R", "KXMAYORNYCPARTY-25-R", "Will Curtis Sliwa win the 2025 NYC mayoral election?", "approx"),
)


def month(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), F.lower(name))


def some(text: Column) -> Column:
    """Null for what an expression did not match."""
    return F.nullif(text, F.lit(""))


def money(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def rate_bucket(question: Column) -> Column:
    """What a venue-1 question says of the rate: unchanged, cut by 25 or more, raised by 25 or more."""
    s = F.lower(question)
    return (
        F.when(s.contains("no change"), "H0")
        .when(s.contains("decrease") & s.contains("25 bps") & ~s.contains("25+"), "C25")
        .when(s.contains("decrease") & s.contains("50+"), "C26")
        .when(s.contains("increase") & s.contains("25+"), "H25PLUS")
    )


def bar_backed(catalog: DataFrame, bars: DataFrame) -> DataFrame:
    """The catalog's markets that have bars."""
    return catalog.join(bars.select("key").distinct(), "key", "left_semi")


def rate_decisions(k: DataFrame, p: DataFrame) -> DataFrame:
    ticker = r"KXFEDDECISION-(\d{2})([A-Z]{3})-([A-Z]\d+)"
    own = k.filter("series_ticker = 'KXFEDDECISION'").select(*(some(F.regexp_extract("key", ticker, i)).alias(c) for i, c in ((1, "yy"), (2, "mon"), (3, "bucket"))), "key", "volume")
    own = own.groupBy("yy", "mon", "bucket").agg(F.min_by(F.struct("key", "volume"), "key").alias("k"))
    text = F.concat(F.lower(F.coalesce("question", F.lit(""))), F.lit(" "), F.coalesce("event_slug", F.lit("")))
    meeting = rf"({'|'.join(MONTHS)})\s*(20\d\d)?"
    year = F.coalesce(some(F.regexp_extract(text, meeting, 2)), F.year("end").cast("string"))
    asked = p.filter(F.col("event_slug").rlike("fed-decision|fed-interest-rates")).select(month(F.regexp_extract(text, meeting, 1)).alias("mon"), F.substring(year, -2, 2).alias("yy"), rate_bucket(F.col("question")).alias("said"), "key", "volume")
    asked = asked.filter("said is not null and yy is not null and mon is not null").withColumn("bucket", F.when(F.col("said") == "H25PLUS", "H25").otherwise(F.col("said")))
    own = own.withColumn("said", F.when(F.col("bucket") == "H25", "H25PLUS").otherwise(F.col("bucket"))).select("yy", "mon", "said", "k.key", "k.volume")
    quality = F.when(F.col("said") == "H25PLUS", "approx").otherwise("exact")
    return sides(own, asked, "fed_decision", F.concat("mon", "yy", F.lit("-"), "said"), F.lit(""), quality)


def sides(k: DataFrame, p: DataFrame, domain: str, unit: Column, part: Column, quality: Column) -> DataFrame:
    """(domain, unit, part, quality, own, key, volume) of a rule: the markets of venue 2 (own) and 1, to be paired where domain, unit and part agree."""
    one = lambda df, own: df.select(F.lit(domain).alias("domain"), unit.alias("unit"), part.alias("part"), quality.alias("quality"), F.lit(own).alias("own"), "key", "volume").filter("unit is not null and part is not null")
    return one(k, True).unionByName(one(p, False))


def nominees(k: DataFrame, p: DataFrame) -> DataFrame:
    named = lambda df, e: df.withColumn("name", some(F.regexp_extract("question", e, 1)))
    own = named(k.filter("series_ticker = 'KXFEDCHAIRNOM'"), r"nominate (.+?) as Fed Chair")
    asked = named(p.filter("event_slug = 'who-will-trump-nominate-as-fed-chair'"), r"nominate (.+?) as the next Fed chair")
    return sides(own, asked, "fed_chair_nom", F.col("name"), F.lit(""), F.lit("exact"))


def strikes(k: DataFrame, p: DataFrame) -> DataFrame:
    """Bitcoin strikes by month and by year: a venue-2 floor lies a cent below the strike that venue 1 names."""
    floor = F.bround(F.col("floor_strike") + 0.01)
    ticker = r"KXBTCMAXMON-BTC-(\d{2})([A-Z]{3})\d{2}-\d+"
    own = k.filter("series_ticker = 'KXBTCMAXMON'").withColumns({"yy": some(F.regexp_extract("key", ticker, 1)), "mon": some(F.regexp_extract("key", ticker, 2)), "strike": floor})
    asked = p.filter(F.col("question").rlike(MONTHLY))
    strike = money(F.regexp_extract("question", MONTHLY, 1)) * F.when(F.regexp_extract("question", MONTHLY, 2) == "k", 1000.0).otherwise(1.0)
    asked = asked.withColumns({"strike": strike, "mon": month(F.regexp_extract("question", MONTHLY, 3)), "yy": F.substring(F.year("end").cast("string"), -2, 2)})
    whole, exactly = F.col("strike").cast("long").cast("string"), (F.col("strike") + 0.0).cast("string")
    monthly = sides(own, asked, "btc_monthly", F.concat("mon", "yy", F.lit("-"), whole), exactly, F.lit("exact"))
    own = k.filter((F.col("series_ticker") == "KXBTCMAXY") & F.col("key").contains("-25-DEC31")).withColumn("strike", floor)
    asked = p.filter(F.col("question").rlike(YEARLY)).withColumn("strike", money(F.regexp_extract("question", YEARLY, 1)))
    return monthly.unionByName(sides(own, asked, "btc_yearly", F.concat(F.lit("Y25-"), whole), exactly, F.lit("approx")))


def by_hand(k: DataFrame, p: DataFrame, pairs=BY_HAND) -> DataFrame:
    """Listed pairs; of several venue-1 markets with the question the one of the largest volume."""
    listed = k.sparkSession.createDataFrame(list(pairs), "unit string, k_key string, question string, quality string")
    # Both catalogs shrink to the listed markets before they are grouped.
    k = k.join(F.broadcast(listed.select(F.col("k_key").alias("key"))), "key", "left_semi")
    p = p.join(F.broadcast(listed.select("question")), "question", "left_semi")
    best = p.groupBy("question").agg(F.min_by(F.struct("key", "volume"), F.struct(-F.coalesce("volume", F.lit(-1.0)), "key")).alias("p"))
    own = k.groupBy(F.col("key").alias("k_key")).agg(F.first("volume").alias("k_vol"))
    met = own.join(F.broadcast(listed), "k_key").join(best, "question")
    place = F.row_number().over(Window.orderBy("unit", "k_key", "p.key"))  # a handful of pairs, each a part of its own
    met = met.withColumn("part", F.format_string("%09d", place)).withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
    one = lambda a, b: F.when(F.col("side"), F.col(a)).otherwise(F.col(b))
    return met.select(F.lit("election").alias("domain"), "unit", "part", "quality", F.col("side").alias("own"), one("k_key", "p.key").alias("key"), one("k_vol", "p.volume").alias("volume"))


def pairs(k: DataFrame, p: DataFrame, hand=BY_HAND) -> DataFrame:
    """(pair_id, domain, unit, k_key, pm_key, k_vol, pm_vol, quality) of all rules, numbered by domain, unit and keys.

    k: venue 2 (key, series_ticker, question, floor_strike, volume); p: venue 1 (key, question, event_slug, end, volume).
    """
    return numbered(reduce(DataFrame.unionByName, [rate_decisions(k, p), nominees(k, p), strikes(k, p), by_hand(k, p, hand)]))


def numbered(markets: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of own and other markets that agree in domain, unit and part, numbered by domain, unit and keys.

    The pairs of a part can grow with the square of the catalogs, so they are numbered before they exist: a pair's number
    is that of its own market's first pair, a running sum over markets, and the other's rank. Pairs then arise in blocks
    of `block` markets of either side, and are neither sorted nor sent. An own key in several parts of a unit is in order by part.
    """
    group = ["domain", "unit", "part"]
    by = Window.partitionBy(*group)
    ours = lambda n: F.sum(F.when(F.col("own"), n).otherwise(0))
    rows = markets.withColumns({"n_own": F.count_if("own").over(by), "n": F.count_if(~F.col("own")).over(by)}).filter("n_own > 0 and n > 0")
    ranked = Window.partitionBy(*group, "own").orderBy("key")
    same = Window.partitionBy(*group, "own", "key")
    rows = rows.withColumns({"rank": F.row_number().over(ranked) - 1, "copies": F.count("*").over(same), "copy": F.row_number().over(same.orderBy("volume")) - 1})
    # Running sums over the markets of a unit, the units of a domain, and the domains.
    before = ours(F.col("n")).over(Window.partitionBy("domain", "unit").orderBy("key", "part")) - F.col("n") * F.col("copies")
    rows = rows.withColumn("before", before)
    units = markets.groupBy(*group).agg((F.count_if("own") * F.count_if(~F.col("own"))).alias("n")).groupBy("domain", "unit").agg(F.sum("n").alias("n"))
    units = units.withColumn("earlier", F.sum("n").over(Window.partitionBy("domain").orderBy("unit")) - F.col("n"))
    domains = units.groupBy("domain").agg(F.sum("n").alias("n"))  # a row for each rule
    domains = domains.select("domain", (F.sum("n").over(Window.orderBy("domain")) - F.col("n")).alias("first"))
    units = units.join(F.broadcast(domains), "domain").select("domain", "unit", (F.col("earlier") + F.col("first")).alias("first"))

    at, blocks = F.floor(F.col("rank") / block), lambda n: F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))
    market = F.struct("key", "volume", "quality", "before", "copies", "copy", "rank")
    placed = rows.withColumn("across", F.explode(F.when(F.col("own"), blocks("n")).otherwise(blocks("n_own"))))
    placed = placed.withColumns({"x": F.when(F.col("own"), at).otherwise(F.col("across")), "y": F.when(F.col("own"), F.col("across")).otherwise(at)})
    met = placed.groupBy(*group, "x", "y").agg(F.collect_list(F.when(F.col("own"), market)).alias("k"), F.collect_list(F.when(~F.col("own"), market)).alias("p"))  # a block of each side
    met = met.join(units, ["domain", "unit"]).select("domain", "unit", "first", F.explode("k").alias("k"), "p").select("domain", "unit", "first", "k", F.explode("p").alias("p"))
    number = F.col("first") + F.col("k.before") + F.col("p.rank") * F.col("k.copies") + F.col("k.copy")
    return met.select(number.cast("long").alias("pair_id"), "domain", "unit", F.col("k.key").alias("k_key"), F.col("p.key").alias("pm_key"), F.col("k.volume").alias("k_vol"), F.col("p.volume").alias("pm_vol"), F.col("k.quality").alias("quality"))
