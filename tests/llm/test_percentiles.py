import math
import random

import numpy as np

from lattica.llm import summaries as S
from lattica.llm import percentiles as P


def error(values, found, p):
    x, n = np.sort(values), len(values)
    k = max(1, math.ceil(p / 100 * n))
    lo, hi = np.searchsorted(x, found, "left") + 1, np.searchsorted(x, found, "right")
    assert lo <= hi
    return max(0, lo - k, k - hi) / n


def summary(values, group, eps):
    x = np.sort(values)
    rank = np.arange(1, len(x) + 1)
    return S.compress((np.full(len(x), group), x, rank, rank.copy()), np.full(group + 1, eps * len(x)))


def test_merging_keeps_the_bound():
    rng = np.random.default_rng(5)
    parts = [np.floor(rng.lognormal(3, 2, rng.integers(1, 4000))) for _ in range(40)] + [np.full(50_000, 7.0)]
    alive = [summary(p, 0, 0.002) for p in parts]
    while len(alive) > 1:
        few, alive = alive[:5], alive[5:]
        source = np.repeat(np.arange(len(few)), [len(t[1]) for t in few])
        g, v, lo, hi = (np.concatenate([t[k] for t in few]) for k in range(4))
        m = S.merge(g, source, v, lo, hi)
        alive.append(S.compress(m, np.array([0.001 * m[3].max()])))
    every = np.concatenate(parts)
    t = alive[0]
    for p in (1, 25, 50, 75, 90, 99):
        found, bound = S.value_at(t, np.array([0]), np.array([len(t[1])]), np.array([max(1, math.ceil(p / 100 * len(every)))]))
        assert error(every, found[0], p) <= bound[0] / len(every) <= 0.01
    assert t[3].max() == len(every) and len(t[1]) < 5000


def test_small_groups_are_exact():
    a, b = summary(np.array([3.0, 1.0]), 0, 0.001), summary(np.array([2.0, 2.0]), 0, 0.001)
    g, v, lo, hi = S.merge(np.zeros(4, int), np.array([0, 0, 1, 1]), *(np.concatenate([a[k], b[k]]) for k in (1, 2, 3)))
    assert v.tolist() == [1, 2, 2, 3] and lo.tolist() == hi.tolist() == [1, 2, 3, 4]


def test_whole_pipeline(spark):
    random.seed(1)
    rows, want = [], {}
    for i in range(6000):
        k = (137 if i % 3 else i % 5, None if i % 11 == 0 else "TEM", 8)
        v = random.choice([math.nan, math.inf, -1.0, P.VALUE_LIMIT, None, float(random.randint(0, 50)), random.lognormvariate(2, 2)])
        row = (*k, f"2021-0{1 + i % 3}-{1 + i % 28:02d}", i, v, v, "n")
        rows += [row] * (1 + (i % 7 == 0))
        if v is not None and 0 <= v < P.VALUE_LIMIT:
            want.setdefault(k, []).append(v)
    df = spark.createDataFrame(rows, "section_no int, channel_name string, bpp int, day string, stat_id bigint, px_median double, px_std double, measure2 string").selectExpr("section_no", "channel_name", "bpp", "to_date(day) day", "stat_id", "px_median", "px_std", "measure2 as n")
    daily = P.summarize(df, P.GROUP, "day", ["px_median", "px_std"], "stat_id", 0.001)
    keys = [*P.GROUP, "measure"]
    got = P.percentiles(P.combine(P.combine(daily.withColumn("month", P.F.trunc("day", "month")), keys, 0.001, "month"), keys, 0.001), keys).collect()
    assert len(got) == 2 * len(want)
    for r in got:
        x = np.array(want[(r.section_no, r.channel_name, r.bpp)])
        assert r.n == len(x) and r.max_rank_error <= 0.01
        assert all(error(x, r[f"p{p:02d}"], p) <= r.max_rank_error for p in P.PERCENTS)
    assert P.summarize(df.limit(0), P.GROUP, "day", ["px_median"], "stat_id", 0.001).count() == 0
