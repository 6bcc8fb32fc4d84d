"""The one-pass bootstrap: exact counts, the right distribution, and no dependence on how rows lie."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import stats


def test_counts_of_samples(spark):
    rows = [("a", float(i % 5)) for i in range(200)] + [("b", 7.0)] * 30 + [("c", float(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "g string, x double")
    draws = 400
    got = stats.resampled(d, "g", ["x"], draws).collect()
    sizes, sums = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[(r["g"], r["draw"])] += r["k"]
        sums[(r["g"], r["x"])].append(r["k"])
    assert sizes == {(g, b): n for g, n in (("a", 200), ("b", 30), ("c", 40)) for b in range(draws)}
    for x in range(5):  # each value's number is binomial
        k = np.array(sums[("a", float(x))])
        assert abs(k.mean() - 40) < 1.5 and abs(k.std() - np.sqrt(200 * 0.2 * 0.8)) < 1
    for x in range(40):
        k = sum(sums[("c", float(x))]) / draws
        assert abs(k - 1) < 0.25
    # Splits are independent enough: numbers of two values go against each other as they must.
    table = {(r["draw"], r["x"]): r["k"] for r in got if r["g"] == "a"}
    a, b = (np.array([table.get((i, x), 0) for i in range(draws)]) for x in (0.0, 1.0))
    assert -0.45 < np.corrcoef(a, b)[0, 1] < -0.05
    again = stats.resampled(d.repartition(5).orderBy(F.desc("x")), "g", ["x"], draws).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sorted(map(tuple, stats.resampled(d, "g", ["x"], draws, seed=1).collect())) != sorted(map(tuple, got))


def test_intervals(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(m)) for g, p, n in (("a", 0.3, 900), ("b", 0.9, 60), (None, 0.5, 100)) for x, m in zip(rng.binomial(4, p, n), [4] * n, strict=True)]
    d = spark.createDataFrame(rows + [("a", None, 1.0)], "g string, x double, m double")
    got = {r["g"]: r for r in stats.one_pass_bootstrap(d, "g", "x", "m", 1000).collect()}
    for g in ("a", "b", None):
        x = np.array([r[1] for r in rows if r[0] == g])
        plain = np.sort([rng.choice(x, len(x)).mean() / 4 for _ in range(3000)])
        assert got[g]["n"] == len(x) and abs(got[g]["mean"] - x.mean() / 4) < 1e-6
        assert abs(got[g]["lo"] - plain[75]) < 0.2 * (plain[2925] - plain[75]) and abs(got[g]["hi"] - plain[2925]) < 0.2 * (plain[2925] - plain[75])
    # The old way, which draws every place, has the same interval to a small part of its width.
    hits = spark.createDataFrame([("a", int(i % 3 == 0)) for i in range(600)], "g string, y int")
    old = stats.bootstrap_rate(hits, "g", F.col("y") == 1, 1000).first()
    new = stats.one_pass_bootstrap(hits, "g", "y", None, 1000).first()
    assert abs(old["lo"] - new["lo"]) < 0.008 and abs(old["hi"] - new["hi"]) < 0.008 and old["rate"] == new["mean"]
    assert stats.one_pass_bootstrap(d.limit(0), "g", "x").count() == 0


def test_hash_bootstrap_by_plain_digests(spark, monkeypatch):
    """Groups whose places cross blocks and lengths of numbers, one without a name, one of many and one without a known item."""
    import hashlib

    rows = [("a", i % 3 == 0) for i in range(1234)] + [("b", True)] * 7 + [(None, i % 2 == 0) for i in range(120)] + [("c", None)] * 3 + [(f"s{i}", i % 2 == 0) for i in range(300)]
    monkeypatch.setattr(stats, "BLOCK", 500)
    d = spark.createDataFrame(rows, "g string, hit boolean")
    got = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_rate(d, "g", F.col("hit"), draws=70, seed=5).collect()}

    def plain(n, k):
        rates = sorted(sum(int(hashlib.md5(f"5|{b}|{pos}".encode()).hexdigest()[:8], 16) % n < k for pos in range(n)) / n for b in range(70))
        return (n, round(k / n, 6), *(round(rates[i], 6) for i in stats.bounds(70)))

    assert len(got) == 304 and got["c"] == (3, None, None, None)
    assert got["a"] == plain(1234, 412) and got["b"] == plain(7, 7) and got[None] == plain(120, 60)
    assert got["s4"] == plain(1, 1) and got["s5"] == plain(1, 0)


def test_hash_bootstrap_shares_numbers(spark):
    """Twelve groups of 30000 under 2000 draws: a number for each group's place would be 720 million digests."""
    import time

    d = spark.range(12 * 30_000).select((F.col("id") % 12).alias("g"), (F.col("id") % 5 == 0).alias("hit"))
    began = time.time()
    got = stats.bootstrap_rate(d, "g", F.col("hit")).collect()
    assert len(got) == 12 and all(r["lo"] < r["rate"] < r["hi"] for r in got)
    assert time.time() - began < 120
