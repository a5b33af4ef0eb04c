"""The command line: listing to catalog, backfill of what is selected, update, SQL over the store."""
import json

import pytest

from oddsmill.__main__ import main
from oddsmill.sources.appended import Store

LISTED = "ticker title open_time close_time result status volume_fp volume open_interest_fp open_interest series_ticker event_ticker strike_type settlement_ts"


def test_commands(spark, tmp_path, capsys):
    at, raw, payloads = (str(tmp_path / x) for x in ("store", "raw", "payloads"))
    say = lambda *a: (main([at, *a], spark), capsys.readouterr().out)[1]
    rows = [(k, k, "2024-01-01T00:00:00Z", "2024-03-01T00:00:00Z", r, s, v, v, *[None] * 6) for k, r, s, v in (("a", "yes", "settled", "50"), ("b", "", "active", "70"), ("c", "no", "settled", "5"))]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in LISTED.split())).selectExpr("*", "CAST(null AS double) floor_strike", "CAST(null AS double) cap_strike").write.parquet(raw)
    one = json.dumps({"history": [{"t": 1, "p": 0.5}]})
    spark.createDataFrame([("w", "1d", k, "points", one) for k in "abc"], "venue string, freq string, key string, kind string, body string").write.parquet(payloads)
    assert say("universe", "w", "tickers", raw).startswith("commit")
    assert "|3 " in say("sql", "SELECT count(*) AS n FROM catalog")
    say("backfill", "w", "1d", payloads, "--only-closed", "--least-volume", "10")
    kept = Store(spark, at)
    assert {r.key for r in kept.read("bars").collect()} == {r.key for r in kept.read("done").collect()} == {"a"}
    say("update", payloads)
    assert {(r.key, r.freq) for r in kept.read("bars").collect()} == {("a", "1d"), ("b", "1d")}
    assert "partitions merged" in say("compact", "bars")
    assert {r.key for r in kept.read("bars").collect()} == {"a", "b"}
    assert say("phases").strip() == ""


def test_wrong_commands(spark, tmp_path):
    for words in (["sql"], ["backfill", "w", "2h", "x"], ["universe", "w", "tickers", "x", "--closed", "--open"], []):
        with pytest.raises(SystemExit):
            main([str(tmp_path), *words], spark)
