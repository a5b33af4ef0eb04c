"""Pairs of markets are numbered before they exist, in blocks, as a sort of all pairs would number them."""
import itertools
import random

import pytest

from oddsmill.operators import matching
from oddsmill.plans.market import View

SCHEMA = "domain string, unit string, part string, quality string, own boolean, key string, volume double"


@pytest.mark.parametrize("block", [1, 3, 512])
def test_numbered(spark, block):
    rng = random.Random(5)
    rows = [(d, u, "", "exact", own, f"k{k}", float(k)) for d in "ba" for u in ("y", "x", "") for own in (True, False) for k in range(rng.randrange(1, 12))]
    rows += [("a", "z", p, "exact", True, f"{p}{k}", 1.0) for p in ("10.0", "10.5") for k in range(4)] + [("a", "z", p, "exact", False, f"q{p}{k}", 2.0) for p in ("10.0", "10.5") for k in range(7)]
    rows += [("b", "x", "", "approx", True, "k0", 9.0), ("b", "x", "", "exact", False, "k0", 8.0), ("b", "x", "", "exact", False, None, 7.0)]  # keys twice, null
    rows += [("a", "alone", "", "exact", True, "k", 1.0), ("c", "alone", "", "exact", False, "k", 1.0)]
    wanted = [(o[0], o[1], o[5], p[5], o[6], p[6], o[3]) for o, p in itertools.product(rows, rows) if o[4] and not p[4] and o[:3] == p[:3]]
    order = lambda r: tuple((x is not None, x) for x in r[:4])
    got = sorted(tuple(r) for r in matching.numbered(spark.createDataFrame(rows, SCHEMA).repartition(3), block).collect())
    assert [r[0] for r in got] == list(range(len(wanted)))
    assert [r[1:5] for r in got] == [r[:4] for r in sorted(wanted, key=order)]
    assert sorted(map(str, (r[1:] for r in got))) == sorted(map(str, wanted))


def test_pairs_are_not_sent(spark):
    """Nothing is sorted or exchanged after pairs arise."""
    plan = matching.pairs(*View(spark, "/root/testdata/sf0.001").venues())._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(p")] if "Generate explode(p" in plan else plan
    assert not any(x in above for x in ("Exchange", "Sort", "Window"))
