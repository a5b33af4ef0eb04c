"""The append-only store, and the backfill job upon it."""
import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from oddsmill.sources import appended, backfill
from oddsmill.sources.appended import Store

BARS = "venue string, freq string, key string, ts timestamp, close double, extra string"


def bars(spark, rows):
    return spark.createDataFrame([(v, f, k, t, c, "x") for v, f, k, t, c in rows], "venue string, freq string, key string, ts string, close double, extra string").withColumn("ts", F.to_timestamp("ts"))


def held(store, name="bars"):
    return sorted((r.venue, r.freq, r.key, str(r.ts), r.close) for r in store.read(name).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def test_merge_on_read_against_a_dictionary(spark, store):
    import random

    r, truth = random.Random(3), {}
    for step in range(6):
        rows = {}
        for _ in range(r.randint(1, 40)):
            rows[(r.choice("ab"), "1d", f"k{r.randint(0, 9)}", f"2024-01-0{r.randint(1, 9)} 00:00:00")] = round(r.random(), 3)
        store.commit({"bars": bars(spark, [(*k, v) for k, v in rows.items()])})
        truth |= rows
        assert held(store) == sorted((*k, v) for k, v in truth.items())
        if step == 3:
            assert store.compact("bars") > 0
            assert held(store) == sorted((*k, v) for k, v in truth.items())
    assert store.state()["version"] == 7


def test_one_bar_writes_one_file_and_reads_of_single_batches_have_no_shuffle(spark, store, tmp_path):
    store.commit({"bars": bars(spark, [("a", "1d", f"k{i}", "2024-01-01 00:00:00", 0.5) for i in range(40)])})
    plan = store.read("bars")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
    before = set((tmp_path / "store" / "bars").rglob("*.parquet"))
    store.commit({"bars": bars(spark, [("a", "1d", "k3", "2024-01-01 00:00:00", 0.9)])})
    assert len(set((tmp_path / "store" / "bars").rglob("*.parquet")) - before) == 1
    assert store.compact("bars", most=1) == 1  # only the bucket that was touched
    assert store.compact("bars", most=1) == 0
    assert ("a", "1d", "k3", "2024-01-01 00:00:00", 0.9) in held(store)
    assert len(held(store)) == 40


def test_a_crash_between_write_and_commit_leaves_the_old_state(spark, store, monkeypatch):
    store.commit({"bars": bars(spark, [("a", "1d", "k", "2024-01-01 00:00:00", 0.1)])})

    def crash(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            store.commit({"bars": bars(spark, [("a", "1d", "k", "2024-01-01 00:00:00", 0.2)]), "done": spark.createDataFrame([("a", "1d", "k")], "venue string, freq string, key string")})
        with pytest.raises(RuntimeError, match="lost"):
            store.compact("bars", most=0)
    assert held(store) == [("a", "1d", "k", "2024-01-01 00:00:00", 0.1)]
    assert store.read("done").count() == 0
    assert store.state()["version"] == 1


def test_writers_at_once_lose_nothing(spark, store):
    rows = [[("a", "1d", f"w{w}", f"2024-01-01 0{i}:00:00", 0.5) for i in range(3)] for w in range(4)]
    threads = [threading.Thread(target=lambda w=w: [store.commit({"bars": bars(spark, [r])}) for r in rows[w]]) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.state()["version"] == 12
    assert held(store) == sorted(r for x in rows for r in x)


def test_a_commit_made_during_compaction_stays_on_top(spark, store, monkeypatch):
    for c in (0.1, 0.2):
        store.commit({"bars": bars(spark, [("a", "1d", "k", "2024-01-01 00:00:00", c)])})
    publish = Store._publish

    def late(self, state):
        monkeypatch.setattr(Store, "_publish", publish)
        self.commit({"bars": bars(spark, [("a", "1d", "k", "2024-01-01 00:00:00", 0.3)])})
        return publish(self, state)  # its number is taken now

    monkeypatch.setattr(Store, "_publish", late)
    assert store.compact("bars") == 1
    assert held(store) == [("a", "1d", "k", "2024-01-01 00:00:00", 0.3)]
    folders = store.state()["files"]["bars"]
    assert len(folders) == 2 and len({o for _, _, o in folders}) == 2


def test_two_compactions_conflict(spark, store, monkeypatch):
    for c in (0.1, 0.2):
        store.commit({"bars": bars(spark, [("a", "1d", "k", "2024-01-01 00:00:00", c)])})
    publish = Store._publish

    def late(self, state):
        monkeypatch.setattr(Store, "_publish", publish)
        self.compact("bars")
        return publish(self, state)

    monkeypatch.setattr(Store, "_publish", late)
    with pytest.raises(appended.Conflict):
        store.compact("bars")
    assert held(store) == [("a", "1d", "k", "2024-01-01 00:00:00", 0.2)]


def test_nulls_ties_strange_names_and_empty_tables(spark, store):
    assert held(store) == [] and store.compact("bars") == 0
    odd = "ve nue/1=%[x]"
    rows = [(odd, "1d", "k:é", "2024-01-01 00:00:00", 0.4), (odd, "1d", "k:é", "2024-01-01 00:00:00", 0.3), (odd, "1d", "k:é", "2024-01-01 00:00:00", None), (None, "1d", "k", "2024-01-01 00:00:00", 0.1), ("", "1d", "k", "2024-01-01 00:00:00", 0.1), ("a", "1d", None, "2024-01-01 00:00:00", 0.1), ("a", "1d", "k", None, 0.1)]
    store.commit({"bars": bars(spark, rows)})
    store.commit({"bars": bars(spark, [])})
    assert held(store) == [(odd, "1d", "k:é", "2024-01-01 00:00:00", 0.3)]
    store.commit({"bars": bars(spark, [(odd, "1d", "k:é", "2024-01-01 00:00:00", 0.7)])})
    assert held(store) == [(odd, "1d", "k:é", "2024-01-01 00:00:00", 0.7)]
    store.compact("bars")
    assert held(store) == [(odd, "1d", "k:é", "2024-01-01 00:00:00", 0.7)]


def test_a_store_keeps_its_buckets(spark, store):
    store.commit({"bars": bars(spark, [("a", "1d", f"k{i}", "2024-01-01 00:00:00", 0.1) for i in range(20)])})
    again = Store(spark, store.path, buckets=32)
    again.commit({"bars": bars(spark, [("a", "1d", f"k{i}", "2024-01-01 00:00:00", 0.2) for i in range(20)])})
    assert {r[4] for r in held(again)} == {0.2} and len(held(again)) == 20


def candle(end, price=None, bid=None, ask=None, **more):
    return {"end_period_ts": end, "price": price, "yes_bid": bid, "yes_ask": ask, **more}


PAYLOADS = [
    ("old", "candles", json.dumps({"candlesticks": [candle(86400, {"open": 40, "high": 60, "low": 39, "close": 55}, {"close": 54}, {"close": 56}, volume=7, open_interest=3)]})),
    ("old", "candles", json.dumps({"candlesticks": [candle(172800, {"open": "0.5000", "high": "0.6", "low": "0.4", "close": "1"}), candle(259200, {}, {"close_dollars": "0.20"}, {"close": 30})]})),
    ("bare", "candles", json.dumps({"candlesticks": [candle(86400, None, {"close": 10}, None), candle(None, {"close": 10})]})),
    ("points", "points", json.dumps({"history": [{"t": 3600, "p": 0.25}, {"t": 90000, "p": "0.5"}, {"t": 90000, "p": 0.75}, {"t": 5, "p": "x"}, None]})),
    ("points", "points", json.dumps({"history": [{"t": 3600, "p": 0.25}]})),
    ("cut", "points", '{"history": [{"t": 1, '),
    ("void", "points", "{}"),
    ("typed", "candles", '{"candlesticks": 5}'),
    ("other", "ticks", "{}"),
    ("nobody", "points", None),
    ("done", "points", '{"history": [{"t": 1, "p": 0.5}]}'),
    ("live", "points", '{"history": [{"t": 1, "p": 0.5}]}'),
    ("unlisted", "points", '{"history": [{"t": 1, "p": 0.5}]}'),
    (None, "points", "{}"),
]
MARKETS = [(k, True) for k in ("old", "bare", "points", "cut", "void", "typed", "other", "nobody", "done", "absent")] + [("live", False), ("live", None), (None, True)]


def tables(spark, payloads=PAYLOADS):
    return spark.createDataFrame(MARKETS, "key string, closed boolean"), spark.createDataFrame([(*p, "clash") for p in payloads], "key string, kind string, body string, closed string")


def test_backfill_parses_checks_and_commits_at_once(spark, store):
    store.commit({"done": spark.createDataFrame([("v", "1d", "done"), ("v", "1h", "old")], "venue string, freq string, key string")})
    backfill.backfill(store, "v", "1d", *tables(spark), phase="bars")
    got = {(r.key, int(r.t)): (r.open, r.high, r.low, r.close, r.bid, r.ask, r.volume, r.open_interest) for r in store.read("bars").withColumn("t", F.unix_timestamp("ts")).collect()}
    assert got == {
        ("old", 86400): (0.4, 0.6, 0.39, 0.55, 0.54, 0.56, 7.0, 3.0),
        ("old", 172800): (0.5, 0.6, 0.4, 1.0, None, None, None, None),
        ("old", 259200): (0.25, 0.25, 0.25, 0.25, 0.2, 0.3, None, None),
        ("points", 86400): (0.25, 0.25, 0.25, 0.25, None, None, None, None),
        ("points", 172800): (0.5, 0.5, 0.5, 0.5, None, None, None, None),
        ("live", 86400): (0.5, 0.5, 0.5, 0.5, None, None, None, None),
    }
    assert sorted((r.freq, r.key) for r in store.read("done").collect()) == [("1d", "done"), ("1d", "old"), ("1d", "points"), ("1h", "old")]
    letters = {r.key: (r.error, r.attempts) for r in store.read("dead_letters").collect()}
    assert letters == {"cut": ("malformed", 1), "typed": ("malformed", 1), "nobody": ("malformed", 1), "other": ("unknown kind", 1), "absent": ("no payload", 1)}
    assert store.state()["phases"] == ["bars"]


def test_dead_letters_count_attempts_and_are_resolved(spark, store):
    backfill.backfill(store, "v", "1d", *tables(spark))
    backfill.backfill(store, "v", "1d", *tables(spark))
    mended = [p for p in PAYLOADS if p[0] != "cut"] + [("cut", "points", '{"history": [{"t": 1, "p": 0.5}]}')]
    backfill.backfill(store, "v", "1d", *tables(spark, mended))
    letters = {r.key: (r.error, r.attempts) for r in store.read("dead_letters").collect()}
    assert letters["cut"] == (None, 0) and letters["absent"] == ("no payload", 3)
    assert "cut" in {r.key for r in store.read("done").collect()}


def test_backfill_of_empty_tables(spark, store):
    markets, payloads = tables(spark)
    backfill.backfill(store, "v", "1h", markets.filter("false"), payloads)
    assert store.read("bars").count() == 0
    backfill.backfill(store, "v", "1h", markets, payloads.filter("false"))
    assert {r.error for r in store.read("dead_letters").collect()} == {"no payload"}


def test_update_tries_what_is_open(spark, store):
    store.commit({"catalog": spark.createDataFrame([("v", "live", False), ("v", "old", True), ("w", "live", None)], "venue string, key string, closed boolean")})
    one = json.dumps({"history": [{"t": 1, "p": 0.5}]})
    payloads = spark.createDataFrame([(v, f, k, "points", one) for v in "vw" for f in ("1m", "1h", "1d") for k in ("live", "old")], "venue string, freq string, key string, kind string, body string")
    backfill.update(store, payloads)
    assert sorted((r.venue, r.freq, r.key, r.t) for r in store.read("bars").withColumn("t", F.unix_timestamp("ts")).collect()) == sorted((v, f, "live", t) for v in "vw" for f, t in (("1m", 60), ("1h", 3600), ("1d", 86400)))
    assert store.read("done").count() == 0


def test_phases_resume_after_a_crash(spark, store):
    ran, broken = [], [True]
    row = lambda k: {"bars": bars(spark, [("a", "1d", k, "2024-01-01 00:00:00", 0.5)])}

    def phase(name):
        def run(s):
            ran.append(name)
            if name == "two" and broken:
                raise RuntimeError("lost")
            return row(name)

        return run

    phases = {n: phase(n) for n in ("one", "two", "three")}
    with pytest.raises(RuntimeError, match="lost"):
        appended.run_phases(store, phases)
    assert [r[2] for r in held(store)] == ["one"] and store.state()["phases"] == ["one"]
    broken.clear()
    assert appended.run_phases(store, phases) == ["two", "three"]
    assert ran == ["one", "two", "two", "three"]
    assert appended.run_phases(store, phases) == []
    assert appended.run_phases(store, phases, only="two") == ["two"]
    assert appended.run_phases(store, phases, since="two") == ["two", "three"]
    with pytest.raises(ValueError, match="no phase"):
        appended.run_phases(store, phases, only="four")
    assert sorted(r[2] for r in held(store)) == ["one", "three", "two"]


def test_universe_selects_and_keeps_the_largest_volume(spark):
    schema = "ticker string, title string, open_time string, close_time string, result string, status string, volume string, volume_fp string, series_ticker string, event_ticker string, floor_strike double, cap_strike double, strike_type string, open_interest string, open_interest_fp string, settlement_ts string"
    day = lambda d: f"2024-01-{d:02}T00:00:00Z"
    one = lambda k, status, v, d: (k, "q", day(1), day(d), "", status, v, None, "S", "E", None, None, "greater", None, None, None)
    raw = spark.createDataFrame([one("a", "settled", "5", 9), one("a", "settled", "7", 9), one("b", "open", "9", 9), one("c", "closed", None, 3), one(None, "open", "1", 9)], schema)
    pick = lambda **k: sorted((r.key, r.volume) for r in backfill.universe(raw, "tickers", **k).collect())
    assert pick() == [("a", 7.0), ("b", 9.0), ("c", None)]
    assert pick(closed=True) == [("a", 7.0), ("c", None)] and pick(closed=False) == [("b", 9.0)]
    assert pick(status="settled") == [("a", 7.0)] and pick(volume=6.0) == [("a", 7.0), ("b", 9.0)] and pick(days=5.0) == [("a", 7.0), ("b", 9.0)]
    with pytest.raises(ValueError, match="no such kind"):
        backfill.universe(raw, uuid.uuid4().hex)
