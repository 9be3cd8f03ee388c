"""Connected groups from candidate buckets, without ever emitting the pairs of a bucket.

Two nodes are candidates when they share a bucket key. ``linked_components`` tests every candidate pair whose
ends are not yet connected and returns the component of every linked node:

1. every node of a bucket is tied to the bucket's smallest node (or to those that a cheap test leaves), and the ties' connected
   components are the *neighbourhoods*: candidates always share one;
2. neighbourhoods are dealt to bins of about ``BIN`` nodes and each bin is compared in one task. A larger neighbourhood is
   split over several bins by the node's hash; about ``PIVOTS`` of its nodes go to all its bins, so that what belongs together
   in different bins is mostly connected through them;
3. in a split neighbourhood, nodes outside its largest component visit the other bins that hold nodes of their buckets and
   are compared with those, at most ``BIN`` visitors in a task. Two nodes of the largest component need no test any more.

So a task holds a bounded number of nodes, and rows grow with the nodes and keys, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyfield.llm.common import rewritten

EDGES = 500_000
BIN = 1024
PIVOTS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every end of ``edges(a, b)``: root is the smallest node that can be reached.

    Edges are dealt to tasks of about EDGES each, which contract theirs to stars by union-find; with one such task that is
    all. Otherwise large-star and small-star steps join the stars of different tasks, and both repeat until the edge table no
    longer changes. Every round cuts lineage, so a lost executor costs one round.
    """
    seen = Observation()
    now = rewritten(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct().observe(seen, F.count("*").alias("n")))
    size, mark = seen.get["n"], None
    while True:
        parts = max(1, -(-size // EDGES))
        dealt = now.repartition(parts, "b") if parts > 1 else now.repartition(1)
        stars = rewritten(dealt.mapInArrow(_contract, "a long, b long"))
        if parts == 1:
            now = stars
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = rewritten(both.join(least, F.col("a") == F.col("u")).where("b > a")
                          .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        now = rewritten(hung.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
                        .observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
        if (sign := (seen.get["n"], seen.get["x"])) == mark:
            break
        size, mark = sign[0], sign
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _contract(batches):
    """The edges of a task as stars around each component's smallest node."""
    held = [(rb.column("a").to_numpy(), rb.column("b").to_numpy()) for rb in batches if rb.num_rows]
    if held:
        ends = [np.concatenate(x) for x in zip(*held, strict=True)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in at.reshape(2, -1).T.tolist():
            forest.join(i, j)  # the smaller index, so the smaller node, becomes the root
        roots = np.array([forest.find(i) for i in range(len(nodes))])
        leaf = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[roots[leaf]])], names=["a", "b"])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def links_within(keys: np.ndarray, matcher, forest: Forest, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of one bin. ``keys`` is nodes x bands; ``matcher(i, others)`` yields the j of ``others`` that
    may link with i, best first, each with a function that decides it. With ``sides`` only pairs of different
    sides are compared."""
    n, found = len(keys), []
    tested = np.zeros((n, n), bool) if n <= 8 * BIN else None
    for band in range(keys.shape[1]):
        order = np.argsort(keys[:, band], kind="stable")
        ranked = keys[order, band]
        cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            group = np.sort(order[lo:hi])
            roots = np.array([forest.find(i) for i in group])
            values, sizes = np.unique(roots, return_counts=True)
            if len(values) < 2:
                continue
            largest = values[np.argmax(sizes)]
            for i in group[roots != largest]:
                i = int(i)
                roots = np.array([forest.find(j) for j in group])
                apart = roots != forest.find(i)
                if sides is not None:
                    apart &= sides[group] != sides[i]
                if tested is not None:
                    apart &= ~tested[i, group]
                others = group[apart]
                if not len(others):
                    continue
                if tested is not None:
                    tested[i, others] = tested[others, i] = True
                for j, decide in matcher(i, others):
                    if forest.find(i) != forest.find(j) and decide():
                        forest.join(i, j)
                        found.append((i, j))
    return found


def ties_of(members: DataFrame) -> DataFrame:
    """Every node of a key tied to the key's smallest node, from ``members(key, node)`` (repeats allowed)."""
    spans = (members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
             .where("low < high").select("key", "low"))
    return members.join(spans, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def linked_components(ties: DataFrame, payload_of: Callable[[DataFrame], DataFrame],
                      open_bin: Callable[[pa.Table], tuple[np.ndarray, Callable]]) -> DataFrame:
    """``node``, ``root`` of all nodes with a link.

    ``ties(a, b)`` connect all candidates, see ``ties_of``. ``payload_of(nodes)`` adds to
    ``nodes(node, q, bin, split)`` what a comparison needs, and ``keys``: the node's bucket keys, needed where ``split`` is not 0.
    ``open_bin(table)`` gives a bin's nodes x bands array, whose columns agree where two nodes share a key, and
    its matcher.
    """
    near = rewritten(connected_components(ties).withColumnRenamed("root", "q"))
    sizes = near.groupBy("q").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # split: 0 in a whole neighbourhood, 1 at home in a bin of a split one, 2 a pivot in another bin
    wide = F.col("n") > BIN
    parts = F.ceil(F.col("n") / BIN).cast("int")
    home = F.pmod(F.xxhash64("node"), parts).cast("int")
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS
    places = F.when(~wide, F.array(F.lit(-1))).when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(home))
    dealt = (near.join(sizes, "q").withColumn("_home", home).withColumn("_place", F.explode(places))
             .select("node", "q",
                     F.when(wide, F.xxhash64("q", "_place")).otherwise(F.pmod(F.xxhash64("q"), F.lit(max(1, total // BIN)))).alias("bin"),
                     F.when(~wide, 0).when(F.col("_place") == F.col("_home"), 1).otherwise(2).alias("split")))
    nodes = rewritten(payload_of(dealt))

    def compare(table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        keys, matcher = open_bin(table)
        forest = Forest(len(ids))
        links_within(keys, matcher, forest)
        roots = np.array([forest.find(i) for i in range(len(ids))])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, ids)
        linked = np.bincount(roots, minlength=len(ids))[roots] > 1
        return pa.table({"node": ids[linked], "root": least[roots[linked]], "split": pa.array(table["split"].to_numpy()[linked], pa.int32())})

    found = rewritten(nodes.groupBy("bin").applyInArrow(compare, "node long, root long, split int"))
    whole = found.where("split = 0").select("node", "root")
    if most <= BIN:
        return whole
    first = rewritten(connected_components(found.where("split > 0").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    settled = rewritten(nodes.where("split = 1").select("node", "q", "bin", "keys").join(first, "node", "left")
                        .select("node", "q", "bin", "keys", F.coalesce("root", "node").alias("root")))
    hubs = (settled.groupBy("q", "root").agg(F.count("*").alias("n")).groupBy("q")
            .agg(F.max(F.struct("n", "root"))["root"].alias("hub")))
    placed = settled.select("node", "q", "bin", "root", F.explode("keys").alias("key"))
    held = placed.select("key", "bin").distinct().withColumnRenamed("bin", "there")
    visits = rewritten(placed.join(hubs, "q").where("root <> hub").select("node", "bin", "key").join(held, "key")
                       .where("bin <> there").select("node", F.col("there").alias("bin")).distinct())
    chunks = visits.groupBy("bin").agg(F.ceil(F.count("*") / BIN).cast("int").alias("chunks"))
    calls = (visits.join(chunks, "bin")
             .select("node", "bin", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("guest")))
    hosts = (settled.select("node", "bin").join(chunks, "bin")
             .select("node", "bin", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("guest")))
    met = (calls.unionByName(hosts).join(settled.select("node", "root"), "node")
           .join(nodes.where("split = 1").drop("bin", "q", "split", "keys"), "node"))

    def compare_guests(table: pa.Table) -> pa.Table:
        ids, roots = table["node"].to_numpy(), table["root"].to_numpy()
        keys, matcher = open_bin(table)
        forest, seen = Forest(len(ids)), {}
        for x, r in enumerate(roots):
            forest.join(x, seen.setdefault(r, x))
        guests = table["guest"].to_numpy(zero_copy_only=False)
        pairs = np.array(links_within(keys, matcher, forest, guests), np.int64).reshape(-1, 2)
        # roots, not nodes: the links inside a component are known
        return pa.table({"a": roots[pairs[:, 0]], "b": roots[pairs[:, 1]]})

    more = met.groupBy("bin", "chunk").applyInArrow(compare_guests, "a long, b long")
    joined = connected_components(more).select(F.col("node").alias("old"), F.col("root").alias("new"))
    late = (settled.select("node", "root").join(joined, F.col("root") == F.col("old"), "left")
            .select("node", F.coalesce("new", "root").alias("root")))
    return whole.unionByName(late)
