"""Command line over an append-only store: universe, backfill, update, sql, compact, phases (spark-submit or python -m oddsmill)."""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from oddsmill.sources import backfill
from oddsmill.sources.appended import TABLES, Store
from oddsmill.sources.store import select_markets


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="oddsmill", description=__doc__)
    top.add_argument("store", help="folder of the store, which driver and executors share")
    sub = top.add_subparsers(dest="command", required=True)
    u = sub.add_parser("universe", help="merge listed markets into the catalog")
    u.add_argument("venue")
    u.add_argument("kind", choices=["outcomes", "tickers"])
    u.add_argument("raw", help="Parquet of market objects")
    side = u.add_mutually_exclusive_group()
    side.add_argument("--closed", action="store_true", default=None)
    side.add_argument("--open", dest="closed", action="store_false")
    u.add_argument("--status")
    u.add_argument("--least-volume", type=float)
    u.add_argument("--least-days", type=float)
    b = sub.add_parser("backfill", help="bars of the catalog's markets that aren't done")
    b.add_argument("venue")
    b.add_argument("freq", choices=sorted(backfill.MINUTES))
    b.add_argument("payloads", help="Parquet of raw replies")
    b.add_argument("--only-closed", action="store_true")
    b.add_argument("--least-volume", type=float)
    b.add_argument("--limit", type=int)
    sub.add_parser("update", help="try all open markets again").add_argument("payloads")
    q = sub.add_parser("sql", help="print a query's rows; the store's tables are views")
    q.add_argument("query")
    q.add_argument("--rows", type=int, default=40, help="rows to print (40)")
    sub.add_parser("compact", help="merge what several batches wrote").add_argument("table", choices=sorted(TABLES))
    sub.add_parser("phases", help="print the phases that are done")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = options().parse_args(argv)
    spark = spark or SparkSession.builder.appName("oddsmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "universe":
        rows = backfill.universe(spark.read.parquet(a.raw), a.kind, a.closed, a.status, a.least_volume, a.least_days)
        print("commit", store.commit({"catalog": rows.withColumn("venue", F.lit(a.venue))}))
    elif a.command == "backfill":
        markets = select_markets(store.read("catalog").filter(F.col("venue") == a.venue), a.only_closed, a.least_volume, a.limit)
        print("commit", backfill.backfill(store, a.venue, a.freq, markets, spark.read.parquet(a.payloads)))
    elif a.command == "update":
        backfill.update(store, spark.read.parquet(a.payloads))
    elif a.command == "sql":
        for name in TABLES:
            store.read(name).createOrReplaceTempView(name)
        spark.sql(a.query).show(a.rows, truncate=False)
    elif a.command == "compact":
        print(store.compact(a.table), "partitions merged")
    else:
        print("\n".join(store.state()["phases"]))


if __name__ == "__main__":
    main()
