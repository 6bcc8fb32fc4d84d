"""Operator 9, approximate nearest neighbours: NN-descent, and greedy search on its graph.

Method. Equal vectors are one node. Nodes are dealt to parts of about PART nodes; a part's row holds its nodes' vectors
(quantised to bytes, for building and search only) and their NEIGHBOURS best neighbours so far. The graph begins with
exact neighbours within blocks of a few random hyperplane partitions. Each round of NN-descent joins every node's
neighbours and reverse neighbours with each other: parts ask the owners for the vectors that their nodes' lists name,
compare all pairs within each list, and send each node the pairs that beat its worst neighbour. Rounds go on until less
than CHANGED of the neighbours are new, ROUNDS at least. A query starts from its own node. Each hop expands the WIDTH best nodes
of its beam that weren't expanded, and compares it with their neighbours, and with no other vectors; a beam keeps the BEAM best
nodes met, and hops go on until every beam's nodes are expanded. The best nodes found are scored again in double precision on
the original vectors, with all of a node's equal vectors that can matter.

Defined results. Null vectors, empty ones, zero vectors and those with null or non-finite components take no part. Each other row is
a candidate, whether or not its id is null or repeated, but for the query's own row; rows that repeat a query are queries
too. Vectors are compared with those of equal length; lengths with fewer than SMALL vectors are searched exactly. Ties go to smaller ids,
null last. With fewer candidates than are asked for, all are returned. Extra columns aren't read.

Scale: all exchanges are between parts of a bounded number of nodes; a node of very many reverse neighbours is sampled, as
the method does. Nothing is broadcast or collected but counts. Every row is indexed. The vectors that a query is compared with
grow with BEAM, hardly with the table; recall falls slowly with size and is governed by NEIGHBOURS and BEAM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textvec

PART, BLOCK, PARTITIONS = 4096, 1024, 3
NEIGHBOURS, ROUNDS = 32, 4
QUERIES, WIDTH, BEAM = 128, 16, 112
CHANGED = 0.005
AGAIN = 16
SMALL = 256
SEED = 20240611

_STATE = "pid bigint, nodes binary, vectors binary, ids binary, sims binary"
_UPDATE = "pid bigint, x binary, ids binary, sims binary"


def part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (textvec.mix(nodes.view(np.uint64) + np.uint64(SEED)) % np.uint64(parts)).astype(np.int64)


def _table(schema: str, *cols) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _joined(column, dtype) -> np.ndarray:
    """All rows' arrays of a binary column, one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def _unit(q: np.ndarray) -> np.ndarray:
    v = q.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def best_of(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int):
    """For each owner its keep best distinct ids, best first."""
    order = np.lexsort((-sims, ids, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims = owner[new], ids[new], sims[new]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < keep
    return owner[top], ids[top], sims[top], rank[top]


def _padded(count: int, owner, ids, sims, rank, keep: int):
    i, s = np.full((count, keep), -1, dtype=np.int64), np.full((count, keep), -2, dtype=np.float32)
    i[owner, rank], s[owner, rank] = ids, sims
    return i, s


class Part:
    """A part's row."""

    def __init__(self, table: pa.Table):
        row = {c: table.column(c)[0].as_py() for c in table.column_names}
        self.pid = row["pid"]
        self.nodes = np.frombuffer(row["nodes"], dtype=np.int64)
        self.vectors = np.frombuffer(row["vectors"], dtype=np.int8).reshape(len(self.nodes), -1)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(len(self.nodes), -1)
        self.sims = np.frombuffer(row["sims"], dtype=np.float32).reshape(len(self.nodes), -1)

    def row(self, ids, sims) -> pa.Table:
        return _table(_STATE, [self.pid], [self.nodes.tobytes()], [self.vectors.tobytes()], [ids.tobytes()], [sims.tobytes()])

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nodes)


def _exchange(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    return left.groupBy("pid").cogroup(right.groupBy("pid")).applyInArrow(fn, schema)


def _updates(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, parts: int) -> pa.Table:
    """Messages to the owners of x: one row a part. ids, sims: (len(x), NEIGHBOURS)."""
    pid = part_of(x, parts)
    order = np.argsort(pid, kind="stable")
    cuts = np.flatnonzero(np.diff(pid[order], prepend=-1))
    groups = np.split(order, cuts[1:]) if len(order) else []
    return _table(_UPDATE, [int(pid[g[0]]) for g in groups], [x[g].tobytes() for g in groups], [ids[g].tobytes() for g in groups], [sims[g].tobytes() for g in groups])


def _requests(schema: str, me: int, nodes: np.ndarray, parts: int) -> pa.Table:
    """Rows (pid, asker, x): which nodes of each part the asker wants."""
    nodes = np.unique(nodes[nodes >= 0])
    pid = part_of(nodes, parts)
    order = np.argsort(pid, kind="stable")
    cuts = np.flatnonzero(np.diff(pid[order], prepend=-1))
    groups = np.split(order, cuts[1:]) if len(order) else []
    return _table(schema, [int(pid[g[0]]) for g in groups], [me] * len(groups), [nodes[g].tobytes() for g in groups])


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, copies, node), distinct in (vec_id, v): v doubles; copies: rows; node: a number of the vector, 0 or more."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(shared.whole_id(F.col(id_col)).alias("vec_id"), v.alias("v")).filter("v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    # Lengths whose squares would leave the range of doubles are scaled; a cosine doesn't change by that.
    most = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when((most > 1e140) | (most < 1e-140), F.transform("v", lambda x: x / most)).otherwise(F.col("v")))
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = shared.settle(rows.withColumn("node", F.shiftrightunsigned(F.xxhash64("v"), 1)), "vectors")
    spread = rows.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    if spread.filter("low <> high").isEmpty():
        return rows
    # Different vectors of one hash: numbered on from it.
    apart = rows.select("node", "v").distinct().withColumn("more", F.row_number().over(Window.partitionBy("node").orderBy("v")) - 1)
    return shared.settle(rows.join(apart, ["node", "v"]).select("vec_id", "v", "copies", (F.col("node") + F.col("more")).alias("node")), "vectors")


def _quantised(rows: pa.Array, d: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x * 127).astype(np.int8)


def build_graph(vectors: DataFrame, d: int, n: int) -> DataFrame:
    """The parts after NN-descent, with reverse neighbours (a sample of NEIGHBOURS) beside each node's own."""
    k, parts = NEIGHBOURS, max(1, -(-n // PART))
    nodes = vectors.select("node", "v").dropDuplicates(["node"])

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            q = _quantised(batch.column(1), d) if len(x) else np.zeros((0, d), np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(x, parts)), batch.column(0), pa.array([r.tobytes() for r in q], pa.binary())], names=["pid", "node", "q"])

    dealt = shared.settle(nodes.mapInArrow(deal, "pid bigint, node bigint, q binary"), "quantised")

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("node").to_numpy()
        order = np.argsort(x)
        q = _joined(table.column("q"), np.int8).reshape(len(x), d)[order]
        return _table(_STATE, [table.column("pid")[0].as_py()], [x[order].tobytes()], [q.tobytes()], [np.full((len(x), k), -1, np.int64).tobytes()], [np.full((len(x), k), -2, np.float32).tobytes()])

    state = dealt.groupBy("pid").applyInArrow(pack, _STATE)

    # Blocks of random hyperplane partitions; a block that comes out too large is split by a hash.
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))
    planes = np.random.default_rng(SEED).normal(size=(PARTITIONS, bits, d)).astype(np.float32)

    def sign(batches):
        for batch in batches:
            v = _joined(batch.column(2), np.int8).reshape(-1, d).astype(np.float32)
            for r in range(PARTITIONS):
                side = (v @ planes[r].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int64) * PARTITIONS + r), batch.column(1), batch.column(2)], names=["block", "node", "q"])

    signed = dealt.mapInArrow(sign, "block bigint, node bigint, q binary")
    sizes = signed.groupBy("block").count()
    salted = signed.join(sizes, "block").withColumn("salt", F.pmod(F.xxhash64("node", "block"), F.ceil(F.col("count") / F.lit(float(BLOCK))).cast("long")))

    def within(table: pa.Table) -> pa.Table:
        x = table.column("node").to_numpy()
        v = _unit(_joined(table.column("q"), np.int8).reshape(len(x), d))
        ids, sims = np.full((len(x), k), -1, np.int64), np.full((len(x), k), -2, np.float32)
        m = min(k, len(x) - 1)
        for a in range(0, len(x), 1024) if m else ():
            s = v[a : a + 1024] @ v.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -2
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            ids[a : a + 1024, :m], sims[a : a + 1024, :m] = x[near], np.take_along_axis(s, near, axis=1)
        return _updates(x, ids, sims, parts)

    updates = salted.groupBy("block", "salt").applyInArrow(within, _UPDATE)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        x, ids, sims = _joined(right.column("x"), np.int64), _joined(right.column("ids"), np.int64), _joined(right.column("sims"), np.float32)
        own = np.repeat(np.arange(len(part.nodes)), k)
        owner = np.concatenate([own, np.repeat(part.at(x), k)])
        ids, sims = np.concatenate([part.ids.ravel(), ids]), np.concatenate([part.sims.ravel(), sims])
        good = (ids >= 0) & (ids != part.nodes[owner])
        return part.row(*_padded(len(part.nodes), *best_of(owner[good], ids[good], sims[good], k), k))

    state = shared.settle(_exchange(state, updates, merge, _STATE), "graph")
    rounds, share = 0, 1.0
    while rounds < ROUNDS or share >= CHANGED:
        lists = shared.settle(_neighbourhoods(state, parts), "neighbourhoods")
        before, state = state, shared.settle(_exchange(state, _joined_lists(state, lists, parts), merge, _STATE), "graph")
        rounds, share = rounds + 1, changed_share(before, state)
        shared.discard(lists, before)
    out = shared.settle(_neighbourhoods(state, parts), "search-graph")
    shared.discard(dealt, state)
    return out


def changed_share(before: DataFrame, after: DataFrame) -> float:
    """Share of the neighbours after a round that weren't there before it."""

    def count(batches):
        for batch in batches:
            every = new = 0
            for was, now in zip(batch.column(0), batch.column(1), strict=True):
                was, now = (np.frombuffer(x.as_py(), dtype=np.int64).reshape(-1, NEIGHBOURS) for x in (was, now))
                for a in range(0, len(now), 512):
                    some = now[a : a + 512] >= 0
                    every += int(some.sum())
                    new += int((some & ~(now[a : a + 512, :, None] == was[a : a + 512, None, :]).any(axis=2)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([every], pa.int64()), pa.array([new], pa.int64())], names=["every", "new"])

    both = before.select("pid", F.col("ids").alias("was")).join(after.select("pid", F.col("ids").alias("now")), "pid").select("was", "now")
    every, new = both.mapInArrow(count, "every bigint, new bigint").agg(F.sum("every"), F.sum("new")).first()
    return new / every if every else 0.0


def _neighbourhoods(state: DataFrame, parts: int) -> DataFrame:
    """The parts with each node's neighbours and a sample of those that have it as a neighbour: 2 NEIGHBOURS ids, padded with -1."""
    k = NEIGHBOURS

    def reverse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(pa.Table.from_batches([batch.slice(i, 1)]))
                x, y = part.ids.ravel(), np.repeat(part.nodes, k)
                x, y = x[x >= 0], y[x >= 0]
                # At most NEIGHBOURS for each node from each part.
                order = np.lexsort((textvec.mix(y.view(np.uint64) ^ x.view(np.uint64)), x))
                x, y = x[order], y[order]
                top = np.arange(len(x)) - np.searchsorted(x, x) < k
                x, y = x[top], y[top]
                pid = part_of(x, parts)
                order = np.argsort(pid, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(pid[order], prepend=-1))[1:]) if len(order) else []
                t = _table("pid bigint, x binary, y binary", [int(pid[g[0]]) for g in groups], [x[g].tobytes() for g in groups], [y[g].tobytes() for g in groups])
                yield from t.to_batches()

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        x, y = _joined(right.column("x"), np.int64), _joined(right.column("y"), np.int64)
        draw = (textvec.mix(y.view(np.uint64) * np.uint64(3) ^ x.view(np.uint64)) >> np.uint64(40)).astype(np.float32)
        ids = _padded(len(part.nodes), *best_of(part.at(x), y, draw, k), k)[0]
        return part.row(np.concatenate([part.ids, ids], axis=1), part.sims)

    return _exchange(state, state.mapInArrow(reverse, "pid bigint, x binary, y binary"), gather, _STATE)


_ASK = "pid bigint, asker bigint, x binary"
_REPLY = "pid bigint, x binary, vectors binary, worst binary"


def _vectors_for(state: DataFrame, asked: DataFrame) -> DataFrame:
    """Replies to requests: vectors of nodes, and the similarity of their worst neighbour."""

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        at = [part.at(np.frombuffer(x.as_py(), dtype=np.int64)) for x in right.column("x")]
        return _table(_REPLY, right.column("asker").to_pylist(), [part.nodes[a].tobytes() for a in at], [part.vectors[a].tobytes() for a in at], [part.sims[a, -1].tobytes() for a in at])

    return _exchange(state, asked, reply, _REPLY)


def _replies(table: pa.Table, d: int):
    x = _joined(table.column("x"), np.int64)
    order = np.argsort(x)
    return x[order], _unit(_joined(table.column("vectors"), np.int8).reshape(len(x), d)[order]), _joined(table.column("worst"), np.float32)[order]


def _joined_lists(state: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """The local joins: for each node, pairs from lists it stands in that beat its worst neighbour."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(pa.Table.from_batches([batch.slice(i, 1)]))
                yield from _requests(_ASK, part.pid, part.ids, parts).to_batches()

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        x, v, worst = _replies(right, part.vectors.shape[1])
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        for a in range(0, len(part.nodes), 512):
            ids = part.ids[a : a + 512]
            at = np.where(ids >= 0, np.searchsorted(x, ids), 0)
            w = v[at]
            s = w @ w.transpose(0, 2, 1)
            good = (s > worst[at][:, :, None]) & (ids >= 0)[:, :, None] & (ids >= 0)[:, None, :] & (ids[:, :, None] != ids[:, None, :])
            u, i, j = np.nonzero(good)
            more = (at[u, i], at[u, j], s[u, i, j])
            best = list(best_of(*(np.concatenate(p) for p in zip(best, more, strict=True)), NEIGHBOURS)[:3])
        owner, ids, sims, rank = best_of(*best, NEIGHBOURS)
        some, owner = np.unique(owner, return_inverse=True)
        return _updates(x[some], *_padded(len(some), owner, x[ids], sims, rank, NEIGHBOURS), parts)

    return _exchange(lists, _vectors_for(state, lists.mapInArrow(ask, _ASK)), join, _UPDATE)


_BEAM = "pid bigint, nodes binary, vectors binary, ids binary, sims binary, done binary, met binary"
_MESSAGE = "pid bigint, asker bigint, x binary, ids binary, vectors binary"


def open_beams(beams: DataFrame) -> int:
    """Number of beams with an unexpanded node."""

    def count(batches):
        for batch in batches:
            some = 0
            for nodes, ids, done in zip(*(batch.column(c) for c in range(3)), strict=True):
                shape = (len(nodes.as_py()) // 8, -1)
                ids, done = np.frombuffer(ids.as_py(), dtype=np.int64).reshape(shape), np.frombuffer(done.as_py(), dtype=np.int8).reshape(shape)
                some += int(((ids >= 0) & (done == 0)).any(axis=1).sum())
            yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64())], names=["some"])

    return beams.select("nodes", "ids", "done").mapInArrow(count, "some bigint").agg(F.sum("some")).first()[0] or 0


class Beams:
    """A row of a group of queries; beams are sorted, best first, and padded with -1."""

    def __init__(self, row: dict, d: int):
        self.pid, self.nodes, self.vectors = row["pid"], np.frombuffer(row["nodes"], dtype=np.int64), row["vectors"]
        n = len(self.nodes)
        self.q = _unit(np.frombuffer(self.vectors, dtype=np.int8).reshape(n, d))
        self.ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, -1)
        self.sims = np.frombuffer(row["sims"], dtype=np.float32).reshape(n, -1)
        self.done = np.frombuffer(row["done"], dtype=np.int8).reshape(n, -1)
        self.met = np.frombuffer(row["met"], dtype=np.int64)

    def to_expand(self) -> np.ndarray:
        """(queries, beam): the WIDTH best unexpanded nodes of each."""
        open_ = (self.ids >= 0) & (self.done == 0)
        return open_ & (np.cumsum(open_, axis=1) <= WIDTH)


def search(graph: DataFrame, starts: DataFrame, d: int, n: int) -> DataFrame:
    """starts: (node), distinct; the beams after greedy search: a row for each group of queries, with the number of comparisons."""
    parts, groups = max(1, -(-n // PART)), max(1, -(-starts.count() // QUERIES))

    def group_asks(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            g = part_of(x + np.int64(7), groups)
            for i in np.unique(g):
                yield from _requests(_ASK, int(i), x[g == i], parts).to_batches()

    def begin(left: pa.Table, right: pa.Table) -> pa.Table:
        part, out = Part(left), []
        for asker, x in zip(right.column("asker").to_pylist(), right.column("x"), strict=True):
            at = part.at(np.frombuffer(x.as_py(), dtype=np.int64))
            one = np.ones(len(at), np.float32)
            out.append((asker, part.nodes[at].tobytes(), part.vectors[at].tobytes(), part.nodes[at].tobytes(), one.tobytes(), np.zeros(len(at), np.int8).tobytes(), np.zeros(len(at), np.int64).tobytes()))
        return _table(_BEAM, *zip(*out, strict=True)) if out else _table(_BEAM, *[[]] * 7)

    beams = shared.settle(_exchange(graph, starts.mapInArrow(group_asks, _ASK), begin, _BEAM), "beams")

    def expand(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = Beams(row, d)
                yield from _requests(_ASK, held.pid, held.ids[held.to_expand()], parts).to_batches()

    def neighbours(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of the expanded nodes: their neighbours to the asker, and its requests for these neighbours' vectors to their owners."""
        part, out = Part(left), []
        for asker, x in zip(right.column("asker").to_pylist(), right.column("x"), strict=True):
            x = np.frombuffer(x.as_py(), dtype=np.int64)
            ids = part.ids[part.at(x)]
            out.append(_table(_MESSAGE, [asker], [-1], [x.tobytes()], [ids.tobytes()], [None]))
            asked = _requests(_ASK, asker, ids.ravel(), parts)
            out.append(_table(_MESSAGE, asked.column("pid"), asked.column("asker"), asked.column("x"), [None] * len(asked), [None] * len(asked)))
        return pa.concat_tables(out) if out else _table(_MESSAGE, *[[]] * 5)

    def hop(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.filter(pa.compute.is_valid(right.column("ids")))
        expanded = _joined(lists.column("x"), np.int64)
        near = _joined(lists.column("ids"), np.int64).reshape(len(expanded), -1) if len(expanded) else np.zeros((0, 1), np.int64)
        order = np.argsort(expanded)
        expanded, near = expanded[order], near[order]
        replies = right.filter(pa.compute.is_valid(right.column("vectors")))
        x = _joined(replies.column("x"), np.int64)
        v = _joined(replies.column("vectors"), np.int8).reshape(len(x), d)
        x, at = np.unique(x, return_index=True)
        v = _unit(v[at])
        out = []
        for row in left.to_pylist():
            held = Beams(row, d)
            now = held.to_expand()
            beam = np.full((len(held.nodes), BEAM), -1, np.int64), np.full((len(held.nodes), BEAM), -2, np.float32), np.ones((len(held.nodes), BEAM), np.int8)
            met = held.met.copy()
            for i in range(len(held.nodes)):
                # This query's own expanded nodes' neighbours, as far as its beam doesn't hold them.
                new = np.unique(near[np.searchsorted(expanded, held.ids[i, now[i]])])
                new = new[(new >= 0) & ~np.isin(new, held.ids[i])]
                ids = np.concatenate([held.ids[i], new])
                sims = np.concatenate([held.sims[i], v[np.searchsorted(x, new)] @ held.q[i]])
                done = np.concatenate([held.done[i] | now[i], np.zeros(len(new), np.int8)])
                order = np.lexsort((ids, -sims))[:BEAM]
                for whole, part in zip(beam, (ids, sims, done), strict=True):
                    whole[i, : len(order)] = part[order]
                met[i] += len(new)
            out.append((held.pid, row["nodes"], held.vectors, *(b.tobytes() for b in beam), met.tobytes()))
        return _table(_BEAM, *zip(*out, strict=True)) if out else _table(_BEAM, *[[]] * 7)

    while open_beams(beams):
        asked = shared.settle(_exchange(graph, beams.mapInArrow(expand, _ASK), neighbours, _MESSAGE), "expanded")
        replies = _vectors_for(graph, asked.filter("asker >= 0").select("pid", "asker", "x"))
        told = asked.filter("asker < 0").unionByName(replies.select("pid", F.lit(0).cast("long").alias("asker"), "x", F.lit(None).cast("binary").alias("ids"), "vectors"))
        before, beams = beams, shared.settle(_exchange(beams, told, hop, _BEAM), "beams")
        shared.discard(asked, before)
    return beams


def best_found(beams: DataFrame, wanted: int) -> DataFrame:
    """(node, found): the best nodes of each beam, the query's own one among them; met: comparisons that the query made."""

    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], dtype=np.int64)
                ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(len(nodes), -1)[:, : wanted + 1]
                q, met = (np.repeat(x, ids.shape[1]) for x in (nodes, np.frombuffer(row["met"], dtype=np.int64)))
                found = ids.ravel()
                good = (found >= 0) & (found != q)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q[good], nodes])), pa.array(np.concatenate([found[good], nodes])), pa.array(np.concatenate([met[good], np.frombuffer(row["met"], dtype=np.int64)]))], names=["node", "found", "met"])

    return beams.mapInArrow(emit, "node bigint, found bigint, met bigint")


def candidates(rows: DataFrame, queries: DataFrame, wanted: int) -> DataFrame:
    """(node, found, met): nodes that may be among the wanted nearest of each query's node. A search for each length of vectors."""
    sized = rows.withColumn("d", F.size("v"))
    counts = {r["d"]: r["n"] for r in sized.groupBy("d").agg(F.approx_count_distinct("node").alias("n"), F.count("*").alias("rows")).collect()}
    few = [d for d, n in counts.items() if n < SMALL]
    small = sized.filter(F.col("d").isin(few)).select("d", F.col("node").alias("found")).distinct()
    out = queries.select("node", F.size("v").alias("d")).filter(F.col("d").isin(few)).distinct().join(small, "d").select("node", "found", F.lit(0).cast("long").alias("met"))
    for d in sorted(set(counts) - set(few)):
        starts = shared.settle(queries.filter(F.size("v") == d).select("node").distinct(), "starts")
        if not starts.isEmpty():
            own = rows.filter(F.size("v") == d)
            n = own.select("node").distinct().count()
            graph = build_graph(own, d, n)
            beams = search(graph, starts, d, n)
            out = out.unionByName(best_found(beams, wanted))
            shared.discard(graph)
        shared.discard(starts)
    return out


def nearest(table: DataFrame, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None) -> DataFrame:
    """(query_id, rank, vec_id, score, compared) of the top nearest of each query; is_query: a condition on vec_id, default divisible by 50.

    compared: the nodes that the search compared the query with; 0 where it was exact.
    """
    rows = valid_vectors(table, id_col, vector_col)
    queries = rows.filter(F.col("vec_id") % 50 == 0 if is_query is None else is_query)
    found = candidates(rows, queries, AGAIN + top)
    # Of equal vectors only those with the smallest ids can be among the nearest.
    ids = F.col("vec_id").asc_nulls_last()
    members = rows.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(ids))).filter(F.col("k") <= top + 1)
    members = members.select(F.col("node").alias("found"), "vec_id", F.col("v").alias("w"), F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(top + 1)))).alias("copy"))
    pairs = queries.select(F.col("vec_id").alias("query_id"), "node", "v", F.col("copies").alias("times")).join(found, "node").join(members, "found")
    own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("found") == F.col("node")) & (F.col("copy") == 1)

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    dot, vv, ww = total(F.zip_with("v", "w", lambda x, y: x * y)), total(F.transform("v", lambda x: x * x)), total(F.transform("w", lambda x: x * x))
    scored = pairs.filter(~own).select("query_id", "node", "times", "vec_id", (dot / (F.sqrt(vv) * F.sqrt(ww))).alias("score"), F.col("met").alias("compared"))
    order = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), ids)
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # A row for each row of the query.
    thousand = F.lit(1000).cast("long")
    best = best.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / thousand))))
    best = best.withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.least(thousand, F.col("times") - F.col("t") * thousand))))
    return best.select("query_id", "rank", "vec_id", "score", "compared")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(shared.table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


#: Exact, with sums in order: the search equals it on small tables, where a block holds all vectors.
ORACLE = r"""
with v as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p as (
  select a.vec_id as query_id, b.vec_id, list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]), lambda x, y: x + y)
    / (sqrt(list_reduce(list_transform(a.v, lambda x: x * x), lambda x, y: x + y)) * sqrt(list_reduce(list_transform(b.v, lambda x: x * x), lambda x, y: x + y))) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
