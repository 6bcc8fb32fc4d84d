"""Evaluation statistics: rates, intervals, agreement and adjustment, as aggregates and column arithmetic."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .rewrite import kept

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z = 1.959963985


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The bounds of the interval, held within 0 and 1."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def hash_draw(b: Column, pos: Column, n: Column, seed) -> Column:
    """A number from 0 to n - 1 for each draw and place."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), pos.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n)


def bounds(draws: int, low: float = 0.025, high: float = 0.975) -> tuple[int, int]:
    """Places of an interval's ends among the sorted draws."""
    return int(low * draws), min(draws - 1, int(high * draws) - (1 if draws >= 2000 else 0))


#: Places that share a row of numbers, draws and groups that are made in one go.
BLOCK, DRAWS, GROUPS = 1 << 16, 50, 256
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _numbered(pos: np.ndarray, at: int) -> list:
    """The 16 words of MD5's one block for numbers of equally many digits that stand from byte `at` on: what is the same in all is one
    number."""
    n = len(str(int(pos[0])))
    held, left = np.zeros((len(pos), 64), dtype=np.uint8), pos
    for i in reversed(range(n)):
        left, digit = np.divmod(left, 10)
        held[:, at + i] = digit + 48
    held[:, at + n] = 0x80
    words = held.view("<u4")
    words[:, 14] = 8 * (at + n)
    return [np.ascontiguousarray(words[:, j]) if at // 4 <= j <= (at + n) // 4 else int(words[0, j]) for j in range(16)]


def _md5_heads(prefix: bytes, words: list) -> np.ndarray:
    """The first 32 bits of the MD5 of the prefix with each number of _numbered after it."""
    lead = np.frombuffer(prefix.ljust(64, b"\0"), dtype="<u4").tolist()
    words = [w | p if isinstance(w, int) else w | np.uint32(p) if p else w for w, p in zip(words, lead, strict=True)]
    size = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(size, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps don't change the first word
        if i < 16:
            j = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            j = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            j = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            j = (7 * i) % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        one = isinstance(words[j], int)
        np.add(f, a, out=f), np.add(f, np.uint32((_SINES[i] + (words[j] if one else 0)) & 0xFFFFFFFF), out=f)
        if not one:
            np.add(f, words[j], out=f)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    # After step 60 the first word stands in b.
    return np.add(b, np.uint32(0x67452301), out=b).byteswap()


def hash_numbers(seed, draws: range, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(draw, first place, numbers) of the places from low to below high, in pieces: those of hash_draw before the remainder is taken."""
    sizes = sorted({low, high, *range(low, high, 1 << 15), *(10**e for e in range(1, 19) if low < 10**e < high)})
    for start, end in itertools.pairwise(sizes):
        pos, by_length = np.arange(start, end), {}
        for b in draws:
            prefix = f"{seed}|{b}|".encode()
            if len(prefix) > 36:
                raise ValueError("the seed is too long")
            if len(prefix) not in by_length:
                by_length[len(prefix)] = _numbered(pos, len(prefix))
            yield b, start, _md5_heads(prefix, by_length[len(prefix)])


def bootstrap_rate(items: DataFrame, group: str, hit: Column, draws: int = 2000, seed=0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, n, rate, lo, hi): a percentile bootstrap of a rate; bounds are sorted draws at int(q * draws).

    Of 0/1 items only their number and the number of hits matter, so draws are made without joining items. A draw's number at a
    place is the same in all groups but for the remainder: it is made once for GROUPS groups that reach as far, in arrays, for
    a block of places and some draws in a row of work, and rows are dealt evenly over tasks.
    """
    sizes = kept(items.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("k")), "sizes")
    known = sizes.filter("k is not null")
    n_groups, longest = known.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    lists, blocks = max(1, -(-n_groups // GROUPS)), max(1, -(-longest // BLOCK))
    rows = lists * blocks * -(-draws // DRAWS)
    far = known.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    far = far.groupBy("low", F.pmod(F.xxhash64("g"), F.lit(lists)).alias("list")).agg(F.collect_list(F.struct("g", "n", "k")).alias("groups"))
    work = far.select("low", "groups", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS))).alias("b")).repartition(min(rows, max(256, rows // 16)))

    def count(batches):
        for batch in batches:
            for i, (start, b) in enumerate(zip(batch.column("low").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                groups = batch.column("groups")[i].values
                ns, ks = (groups.field(c).to_numpy() for c in ("n", "k"))
                hits = np.zeros((min(DRAWS, draws - b), len(groups)), dtype=np.int64)
                for draw, at, h in hash_numbers(seed, range(b, b + len(hits)), start, int(min(start + BLOCK, ns.max()))):
                    for j in np.flatnonzero(ns > at):
                        own = h[: ns[j] - at]
                        hits[draw - b, j] += np.count_nonzero((own % np.uint32(ns[j]) if ns[j] < 1 << 32 else own) < ks[j])
                every = pa.array(np.tile(np.arange(len(groups)), len(hits)))
                of = [groups.field(c).take(every) for c in ("g", "n", "k")]
                yield pa.RecordBatch.from_arrays([*of, pa.array(np.repeat(np.arange(b, b + len(hits), dtype=np.int32), len(groups))), pa.array(hits.ravel())], ["g", "n", "k", "b", "hits"])

    schema = StructType([sizes.schema["g"], *(StructField(c, t) for c, t in (("n", LongType()), ("k", LongType()), ("b", IntegerType()), ("hits", LongType())))])
    rates = work.mapInArrow(count, schema).groupBy("g", "n", "k", "b").agg((F.sum("hits") / F.col("n")).alias("r"))
    held = rates.groupBy("g", "n", "k").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    held = held.unionByName(sizes.filter("k is null").withColumn("rs", F.lit(None).cast("array<double>")))
    at = [F.round(F.element_at("rs", k + 1), 6) for k in bounds(draws, low, high)]
    return held.select(F.col("g").alias(group), "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), at[0].alias("lo"), at[1].alias("hi"))


def paired_cluster_bootstrap(clusters: DataFrame, draws: int = 5000, seed=2026) -> DataFrame:
    """clusters: (pos from 0, a_sum, a_n, b_sum, b_n). (diff, lo, hi, p): difference of means, and its two-sided p."""
    n = clusters.count()
    spark: SparkSession = clusters.sparkSession
    picks = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("at"))
    picks = picks.select("b", hash_draw(F.col("b"), F.col("at"), F.lit(n), seed).alias("pos"))
    sums = picks.join(F.broadcast(clusters), "pos").groupBy("b").agg((F.sum("a_sum") / F.sum("a_n") - F.sum("b_sum") / F.sum("b_n")).alias("d"))
    held = sums.agg(F.array_sort(F.collect_list("d")).alias("ds"), F.avg((F.col("d") <= 0).cast("double")).alias("below"), F.avg((F.col("d") >= 0).cast("double")).alias("above"))
    point = clusters.agg((F.sum("a_sum") / F.sum("a_n") - F.sum("b_sum") / F.sum("b_n")).alias("diff"))
    at = [F.round(F.element_at("ds", k + 1), 6) for k in bounds(draws)]
    return point.crossJoin(held).select(F.round("diff", 6).alias("diff"), at[0].alias("lo"), at[1].alias("hi"), F.round(F.least(F.lit(1.0), 2 * F.least("below", "above")), 6).alias("p"))


def cluster_bootstrap_mean(clusters: DataFrame, draws: int = 5000, seed=2026) -> DataFrame:
    """clusters: (pos from 0, total, n). (mean, lo, hi): the mean over all items, by drawing whole clusters."""
    n = clusters.count()
    picks = clusters.sparkSession.range(draws * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("at"))
    picks = picks.select("b", hash_draw(F.col("b"), F.col("at"), F.lit(n), seed).alias("pos"))
    drawn = picks.join(F.broadcast(clusters), "pos").groupBy("b").agg((F.sum("total") / F.sum("n")).alias("m")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    lo, hi = (F.round(F.element_at("ms", k + 1), 6) for k in bounds(draws))
    return clusters.agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean")).crossJoin(drawn.select(lo.alias("lo"), hi.alias("hi")))


def cohen_categorical(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, po, pe, kappa, pabak) of two raters with any categories; kappa is null where chance agreement is 1."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    n = cells.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("k"))), F.lit(0)).alias("same"))
    rows, cols = cells.groupBy("a").agg(F.sum("k").alias("x")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("k").alias("y"))
    chance = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).select("n", F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"), F.round(2 * po - 1, 6).alias("pabak"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """The step-down adjustment: a running maximum of (m - rank + 1) p, one at most. A table of tests is small."""
    m = df.groupBy().agg(F.count("*").alias("m"))
    order = Window.orderBy(p, key)
    ranked = df.crossJoin(F.broadcast(m)).withColumn("rn", F.row_number().over(order))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("p_holm", F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("rn") + 1) * F.col(p)).over(run)), 6)).drop("m", "rn")


def cohen(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, po, pe, kappa, pabak) of two raters with two categories; kappa is 1 where chance agreement is."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    g = g.withColumn("pe", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    kappa = F.when(F.col("pe") >= 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return g.select(*(by or []), "n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(kappa, 6).alias("kappa"), F.round(2 * F.col("po") - 1, 6).alias("pabak"))


def fleiss(df: DataFrame, raters: list[str]) -> DataFrame:
    """(n, p_bar, p_e, kappa, free) of several raters with two categories."""
    m = float(len(raters))
    ones = sum((F.col(r).cast("double") for r in raters), F.lit(0.0))
    g = df.select(ones.alias("k")).agg(F.count("*").alias("n"), F.avg((F.col("k") * (F.col("k") - 1) + (m - F.col("k")) * (m - F.col("k") - 1)) / (m * (m - 1))).alias("pb"), (F.sum("k") / (F.count("*") * m)).alias("q"))
    g = g.withColumn("pe", F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q")))
    return g.select("n", F.round("pb", 6).alias("p_bar"), F.round("pe", 6).alias("p_e"), F.round(F.when(F.col("pe") < 1, (F.col("pb") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"), F.round((F.col("pb") - 0.5) / 0.5, 6).alias("free"))


def majority(columns: list[str]) -> Column:
    """What most of three or more raters say; null counts for neither."""
    yes = sum((F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return (yes * 2 > len(columns)).cast("int")


def prf(matched: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; an empty side is 1 if nothing was to be matched."""
    none = F.when(matched == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p, r = F.when(predicted == 0, none).otherwise(matched / predicted), F.when(gold == 0, none).otherwise(matched / gold)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# ---- bootstraps in one pass over the items


def _binomial(key: Column, n: Column, p: Column) -> Column:
    """A binomial draw that depends on its key alone."""

    @F.pandas_udf("bigint")
    def draw(keys: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        made = [np.random.Generator(np.random.Philox(key=k & 0xFFFFFFFFFFFFFFFF)).binomial(a, b) for k, a, b in zip(keys, ns, ps, strict=True)]
        return pd.Series(made, dtype="int64")

    return draw(key, n, p)


def resampled(items: DataFrame, group: str, values: list[str], draws: int, seed: int = 0) -> DataFrame:
    """(group, draw, *values, k): how often each distinct row of values comes in each of so many samples with replacement, as large as
    the group; those that don't come have no row.

    Items are only counted. A sample's counts are made by a tree over the distinct rows, ordered by the bits of a hash: a node's
    count is split between its halves by a binomial draw that depends on the seed, the group, the draw and the node. Rows number
    draws times distinct rows, however many items there are.
    """
    held = kept(items.groupBy(group, *values).agg(F.count("*").alias("w")).withColumn("h", F.xxhash64(F.lit(seed), *values)), "bootstrap")
    now = held.groupBy(group).agg(F.sum("w").alias("w"), F.count("*").alias("distinct")).withColumn("k", F.col("w"))
    now = kept(now.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("node", F.lit(0).cast("long")), "draws")
    done, level = [], 0
    while True:
        whole = F.shiftrightunsigned("h", 64 - level) if level else F.lit(0).cast("long")
        alone = now.filter("distinct = 1").select(group, "draw", "node", "k")
        done.append(alone.join(held.withColumn("node", whole).drop("w", "h"), [group, "node"]).select(group, "draw", *values, "k"))
        now = now.filter("distinct > 1")
        if level == 64 or now.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level += 1
        parts = held.groupBy(group, F.shiftrightunsigned("h", 64 - level).alias("part")).agg(F.sum("w").alias("w"), F.count("*").alias("distinct"))
        halves = parts.groupBy(group, F.shiftrightunsigned("part", 1).alias("node")).agg(*[F.coalesce(F.max(F.when(F.col("part") % 2 == b, F.col(c))), F.lit(0)).alias(f"{c}{b}") for c in ("w", "distinct") for b in (0, 1)])
        split = now.select(group, "draw", "node", "k").join(halves, [group, "node"])
        split = split.withColumn("left", _binomial(F.xxhash64(F.lit(seed), group, "draw", "node", F.lit(level)), F.col("k"), F.col("w0") / (F.col("w0") + F.col("w1"))))
        sides = [F.struct((F.col("node") * 2 + b).alias("node"), F.col(f"w{b}").alias("w"), F.col(f"distinct{b}").alias("distinct"), (F.col("left") if b == 0 else F.col("k") - F.col("left")).alias("k")) for b in (0, 1)]
        now = kept(split.select(group, "draw", F.explode(F.array(*sides)).alias("s")).select(group, "draw", "s.*").filter("k > 0"), "draws")


def one_pass_bootstrap(items: DataFrame, group: str, value: str, size: str | None = None, draws: int = 2000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, n, mean, lo, hi): a percentile bootstrap of a mean over items, or over clusters with their sizes: sums of value by
    sums of size. Rows with a null value are left out."""
    weight = F.lit(1).cast("double") if size is None else F.col(size).cast("double")
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))  # a group without a name is one too
    d = items.filter(F.col(value).isNotNull()).select(name.alias("g"), F.col(group).alias("name"), F.col(value).cast("double").alias("x"), weight.alias("m")).filter("m is not null")
    point = d.groupBy("g").agg(F.first("name").alias("name"), F.count("*").alias("n"), (F.sum("x") / F.sum("m")).alias("mean"))
    means = resampled(d, "g", ["x", "m"], draws, seed).groupBy("g", "draw").agg((F.sum(F.col("x") * F.col("k")) / F.sum(F.col("m") * F.col("k"))).alias("r"))
    held = means.groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    at = [F.round(F.element_at("rs", k + 1), 6) for k in bounds(draws, low, high)]
    return point.join(held, "g").select(F.col("name").alias(group), "n", F.round("mean", 6).alias("mean"), at[0].alias("lo"), at[1].alias("hi"))
