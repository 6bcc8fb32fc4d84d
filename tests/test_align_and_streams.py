"""Alignment against all maps, and the rolling budget against a plain queue."""

import random
import time
from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import align
from quillgraph.streaming import limiter


def by_all_maps(nodes_a, edges_a, nodes_b, edges_b):
    kinds = sorted(set(nodes_a) & set(nodes_b))
    left, right = ({k: [i for i, t in enumerate(n) if t == k] for k in kinds} for n in (nodes_a, nodes_b))

    def maps(k):
        a, b = left[k], right[k]
        return [dict(zip(a, p, strict=True)) for p in permutations(b, len(a))] if len(a) <= len(b) else [dict(zip(p, b, strict=True)) for p in permutations(a, len(b))]

    have_a, have_b, best = Counter(edges_a), Counter(edges_b), 0
    for parts in product(*map(maps, kinds)):
        to = {i: j for p in parts for i, j in p.items()}
        best = max(best, sum(min(n, have_b[(to.get(s), k, to.get(t))]) for (s, k, t), n in have_a.items()))
    return sum(min(len(left[k]), len(right[k])) for k in kinds), best


def random_graph(rng, nodes, edges):
    n = rng.randrange(1, nodes)
    return [rng.choice("AB") for _ in range(n)], [(rng.randrange(n), rng.choice("xy"), rng.randrange(n)) for _ in range(rng.randrange(edges))]


def test_alignment_by_all_maps():
    rng = random.Random(11)
    for nodes, edges, rounds in ((6, 8, 1500), (7, 12, 150)):
        for _ in range(rounds):
            a, b = random_graph(rng, nodes, edges), random_graph(rng, nodes, edges)
            assert align.best_alignment(*a, *b) == by_all_maps(*a, *b)


def test_assignment():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 6)
        m = rng.randrange(n, 7)
        gain = [[rng.randrange(5) for _ in range(m)] for _ in range(n)]
        assert align.assignment(gain) == max(sum(gain[i][c] for i, c in enumerate(p)) for p in permutations(range(m), n))
    assert align.assignment([]) == 0


def test_hubs_of_equal_types():
    began, k = time.process_time(), 60
    leaves = (["H"] + ["L"] * k, [(0, "x", i + 1) for i in range(k)])
    fewer = (["L"] * (k - 3) + ["H"], [(k - 3, "x", i) for i in range(k - 5)])
    assert align.best_alignment(*leaves, *fewer) == (k - 2, k - 5)
    pairs = (["R", "D"] * k, [(2 * i, "x", 2 * i + 1) for i in range(k)])
    others = (["D", "R"] * k, [(2 * i + 1, "x", 2 * i) for i in range(k - 4)] + [(1, "y", 0)])
    assert align.best_alignment(*pairs, *others) == (2 * k, k - 4)
    # Where the count of edges by type can't be reached.
    two = (["H", "H"] + ["L"] * 20, [(h, "x", i + 2) for i in range(20) for h in (0, 1)])
    one = (["H", "H"] + ["L"] * 20, [(i % 2, "x", i + 2) for i in range(20)])
    assert align.best_alignment(*two, *one) == (22, 20)
    mixed = (["H", "H"] + ["L"] * 20, [(0, "x", i + 2) for i in range(20)] + [(1, "y", i + 2) for i in range(20)])
    dealt = (["H", "H"] + ["L"] * 20, [(i % 2, "x", i + 2) for i in range(20)] + [(i // 2 % 2, "y", i + 2) for i in range(20)])
    assert align.best_alignment(*mixed, *dealt) == (22, 20)
    assert time.process_time() - began < 20


def plain_queue(calls, budget, seconds, rate):
    """When each call may go, one by one; None: never."""
    window, out = int(seconds * 1_000_000), {}
    last, went = {}, {}
    for key, id_, at, cost in sorted(calls, key=lambda c: (c[2], c[1])):
        if cost > budget or rate == 0:
            last[key] = max(at, last.get(key, at))
            out[id_] = None
            continue
        now = max(at, last.get(key, at))
        while True:
            inside = [(t, c) for t, c in went.get(key, []) if t > now - window]
            if sum(c for _, c in inside) + cost <= budget and (rate is None or len(inside) < rate):
                break
            now = min(t for t, _ in inside) + window
        went.setdefault(key, []).append((now, cost))
        last[key], out[id_] = now, now
    return out


def stream_in(spark, path, rows):
    d = spark.createDataFrame(rows, "key string, id bigint, us bigint, cost double")
    d.select("key", "id", F.timestamp_micros("us").alias("ts"), "cost").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("rate", [None, 3])
def test_rolling_budget(spark, tmp_path, rate):
    rng = random.Random(7)
    base = 1_700_000_000_000_000
    calls = [(rng.choice(["a", "a", "a", "b", "c"]), i, base + rng.randrange(300) * 1_000_000 + rng.randrange(3), float(rng.choice([1, 5, 20, 60, 101]))) for i in range(150)]
    calls.sort(key=lambda c: c[2])
    end = ("", -1, base + 10**10, 0.0)
    schema = "key string, id bigint, ts timestamp, cost double"
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    # Three runs, each going on from the checkpoint of the one before it, the second in no order.
    first, second = calls[:60], calls[60:]
    rng.shuffle(second)
    for part in (first, [*second, (None, 1000, base, 1.0), ("a", None, base, 1.0), ("a", 1001, None, 1.0)], [end]):
        stream_in(spark, folder, part)
        limiter.run_limited(spark.readStream.schema(schema).parquet(folder), sink, checkpoint, 100.0, 30.0, rate, late="10 minutes")
    got = {r["id"]: r["admitted_at"] for r in spark.read.schema(limiter.ADMITTED).parquet(sink).filter("key <> ''").collect()}
    want = plain_queue(calls, 100.0, 30.0, rate)
    assert got == want and any(v is None for v in want.values()) and sum(v is not None and v > base + 300_000_000 for v in want.values()) > 5


def test_totals_and_backoff(spark):
    d = spark.createDataFrame([("a", 1, 10, 5), ("a", 0, 20, None), ("b", 2, 1, 1), (None, None, None, None)], "key string, retries int, prompt_tokens long, completion_tokens long")
    got = {r["key"]: tuple(r)[1:] for r in limiter.usage_totals(d).collect()}
    assert got == {"a": (2, 1, 30, 5, 35), "b": (1, 2, 1, 1, 2), None: (1, 0, 0, 0, 0)}
    w = spark.createDataFrame([(0, True), (2, True), (3, False)], "n int, limited boolean").select(limiter.backoff(F.col("n"), F.col("limited"), 2.0).alias("s")).collect()
    assert [r["s"] for r in w] == [2.0, 18.0, 16.0]


def test_a_table_is_replayed_in_batches(spark, tmp_path, monkeypatch):
    """Many calls at a time come in batches in the order of their times, and nothing is late or lost."""
    from quillgraph import spaces
    from quillgraph.catalog import QUERIES

    rng = random.Random(3)
    base, kinds = 1_700_000_000_000_000, ["a", "b"]
    rows = [(i, base + rng.choice([7, rng.randrange(40)]) * 3_600_000_000 + rng.randrange(2), rng.choice(kinds), float(rng.randrange(1, 300))) for i in range(900)] + [(1000, None, "a", 1.0), (1001, base, None, 1.0)]
    d = spark.createDataFrame(rows, "event_id bigint, us bigint, event_type string, value double").repartition(7)
    d.select("event_id", F.timestamp_micros("us").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(spaces, "CALLS", 100, raising=False)
    taken = []
    run = limiter.run_limited

    def watched(calls, sink, checkpoint, *rest, **more):
        run(calls, sink, checkpoint, *rest, **more)
        taken.append(calls.sparkSession.read.text(f"{checkpoint}/sources/0").filter("value like '{%'").select(F.get_json_object("value", "$.batchId")).distinct().count())

    monkeypatch.setattr(limiter, "run_limited", watched)
    got = {r["id"]: r["waited"] for r in QUERIES["limited_calls"](spark, str(tmp_path)).collect()}
    calls = [(k, i, at, v * 100) for i, at, k, v in rows if at is not None and k is not None]
    want = plain_queue(calls, spaces.BUDGET, spaces.WINDOW, None)
    assert got == {i: want[i] - at for _, i, at, _ in calls} and taken[0] >= 5
