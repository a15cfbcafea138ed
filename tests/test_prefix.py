"""Running sums in two levels, and ranks and bootstraps made from them, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fluxpanel.functions.prefix import with_before
from fluxpanel.operators import stats


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_equal_brute_force(spark, by):
    rnd = random.Random(1)
    rows = {(rnd.choice([None, 0, 1, 2]) if by else None, rnd.randrange(3000)): (rnd.randrange(5), rnd.choice([None, 1, 2])) for _ in range(2000)}
    df = spark.createDataFrame([(g, v, *x) for (g, v), x in rows.items()], "g int, v int, a bigint, b bigint").repartition(7)
    got = {(r["g"], r["v"]): r for r in with_before(df, by, "v", ["a", "b"]).collect()}
    assert got.keys() == rows.keys()
    for (g, v), r in got.items():
        for i, c in enumerate("ab"):
            assert r[f"{c}_before"] == sum(x[i] or 0 for (h, w), x in rows.items() if h == g and w < v)
            assert r[f"{c}_total"] == sum(x[i] or 0 for (h, _), x in rows.items() if h == g)
    assert with_before(df.limit(0), by, "v", ["a"]).count() == 0


def test_ranges_split_one_group(spark):
    """A single group lies in several tasks, and so does one that holds nearly all rows."""
    df = spark.range(0, 20_000).selectExpr("cast(0 as int) g", "id v", "1 n").union(spark.range(3).selectExpr("cast(1 as int) g", "id v", "1 n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_before(df, ["g"], "v", ["n"])
        assert max(r["n_before"] for r in out.filter("g = 0").collect()) == 19_999
        ranges = df.repartitionByRange("g", "v").selectExpr("g", "spark_partition_id() p").groupBy("g").agg({"p": "max"}).collect()
        assert max(r[1] for r in ranges) >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bootstrap_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(14), rnd.choice([1.0, 2.0, rnd.random()]), rnd.choice([5.0, 5.0, rnd.random() * 9])) for _ in range(150)] + [(3, 1.0, 5.0)] * 40
    df = spark.createDataFrame(rows, "c int, v double, q double").repartition(5)
    got = dict(map(tuple, stats.bootstrap(df, "v", "q", "c", 30).collect()))
    ids = sorted({r[0] for r in rows})
    assert len(got) == 30
    for i in range(30):
        times = Counter(ids[int(hashlib.md5(f"{i}-{s}".encode()).hexdigest()[:15], 16) % len(ids)] for s in range(len(ids)))
        taken = [(v, q) for c, v, q in rows for _ in range(times[c])]
        lo, hi = np.quantile([q for _, q in taken], [0.25, 0.75])
        one, four = [v for v, q in taken if q <= lo], [v for v, q in taken if q > hi]
        u = sum((a > b) + 0.5 * (a == b) for a in one for b in four)
        want = u / (len(one) * len(four)) if one and four else None
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None
