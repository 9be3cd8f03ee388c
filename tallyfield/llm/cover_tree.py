"""Hard-negative mining with cover trees over norm-augmented vectors.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the longest norm, so that all have norm M and a distance in
the augmented space gives an inner product: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. A node of a cover tree has a centre and a covering
radius, the greatest distance of what is below it; both together bound the inner product of an anchor with every
vector below from both sides.

All rows are indexed. The top of the tree is a net of at most CELLS centres, spread by farthest-first steps over a sample of SAMPLE rows by
hash; each row goes to its nearest centre's cell, and a cell is cut by hash into bins of about ``bin_rows`` rows, so that a
crowded cell (or a vector that a third of all rows share) is many bins. Each bin has its own tree below the centre. Anchors are searched
in blocks: a block meets the bins of those cells that its bounds can't exclude, a share of them in a task, the most promising
first. Shares grow with the rows, so that the number of tasks and of their results does not; a task reads its block once and then its trees, one
after the other. Inside a tree nodes are taken best first; a node whose bounds lie outside an anchor's windows, or below what the anchor
already holds, is skipped for it, and leaves are verified by exact integer products.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, rewritten, small_batches

#: Centres of the top net and rows that choose them; children of a node, vectors of a leaf, bins that one task searches at least.
CELLS, SAMPLE = 64, 2048
FANOUT, LEAF, SHARE = 32, 64, 4
#: Numbers that a bin's vectors and a block's anchors hold, about.
BIN_NUMBERS, BLOCK_NUMBERS = 1 << 17, 1 << 21
#: Tasks of a search for each of Spark's shuffle partitions, at most; found rows between two looks at which of them still count.
TASKS, FOUND = 2, 1 << 20


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array; shorter ones end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _quantized(scale: float):
    def run(batches):
        for rb in batches:
            lists = rb.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            fine = np.bincount(row, ~np.isfinite(values), minlength=len(sizes)) == 0
            with np.errstate(invalid="ignore"):
                whole = np.floor(values * scale)
            norm = np.bincount(row, np.where(np.isfinite(whole), whole, 0) ** 2, minlength=len(sizes))
            kept = fine[row]
            ends = np.concatenate([[0], np.cumsum(sizes[fine])])
            yield batch(["vec_id", "label", "anchor", "v", "norm2"],
                        [*(rb.column(c).filter(pa.array(fine)) for c in ("vec_id", "label", "anchor")),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole[kept])), norm[fine]],
                        [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.float64()])
    return run


class Space:
    """The augmented space of vectors whose squared norms are at most ``top``."""

    def __init__(self, top: float):
        self.top = top

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))

    def distances(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Between all rows of x and c, both augmented."""
        inner = x @ c.T + self.extra(x)[:, None] * self.extra(c)[None]
        return np.sqrt(np.maximum(2 * self.top - 2 * inner, 0))

    def bounds(self, q2: np.ndarray, inner: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of anchors (squared norms ``q2``) with vectors within ``radius`` of centres that have ``inner``."""
        whole = q2[:, None] + self.top
        away = np.sqrt(np.maximum(whole - 2 * inner, 0))
        slack = 1e-9 * whole + 1e-3  # for rounding; scores are whole numbers
        return ((whole - (away + radius) ** 2) / 2 - slack, (whole - np.maximum(away - radius, 0) ** 2) / 2 + slack)

    def net(self, x: np.ndarray, most: int, target: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Farthest-first centres among the rows until all are within ``target`` of one, ``most`` at most; each row's centre and distance."""
        chosen = [0]
        near, owner = self.distances(x, x[:1])[:, 0], np.zeros(len(x), np.int64)
        while len(chosen) < most and near.max() > target:
            far = int(np.argmax(near))
            away = self.distances(x, x[far:far + 1])[:, 0]
            away[far] = 0
            closer = away < near
            near, owner = np.where(closer, away, near), np.where(closer, len(chosen), owner)
            chosen.append(far)
        return np.array(chosen), owner, near


def grow(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, space: Space, keep: int) -> dict[str, np.ndarray]:
    """The cover tree of a bin as arrays. Equal vectors are one point; of its rows with one label the ``keep`` smallest ids stay,
    as no search can return more of them."""
    points, at = np.unique(x, axis=0, return_inverse=True)
    rows = np.unique(np.stack([at.ravel(), labels, ids], 1), axis=0)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    first = np.flatnonzero(new)
    rows = rows[np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < keep]
    order, nodes = np.empty(len(points), np.int64), []
    # center, radius, first child, end of children, first point, end of points
    queue = [(np.arange(len(points)), 0, float(space.distances(points, points[:1]).max()), 0)]
    for members, center, radius, start in queue:
        node = [center, radius, 0, 0, start, start + len(members)]
        nodes.append(node)
        order[start:start + len(members)] = members
        if len(members) > LEAF and radius > 0:
            lead = members[np.argsort(members != center, kind="stable")]
            chosen, owner, near = space.net(points[lead], FANOUT, radius / 2)
            node[2] = len(queue)
            for k in range(len(chosen)):
                mine = owner == k
                queue.append((lead[mine], int(lead[chosen[k]]), float(near[mine].max()), start))
                start += int(mine.sum())
            node[3] = len(queue)
    # points in the order of the leaves, rows behind their points
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    rows[:, 0] = place[rows[:, 0]]
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    shape = np.array(nodes)
    return {"points": points[order], "centers": points[shape[:, 0].astype(np.int64)], "radius": shape[:, 1], "kids": shape[:, 2:4].astype(np.int64),
            "span": shape[:, 4:6].astype(np.int64), "at": rows[:, 0], "label": rows[:, 1], "id": rows[:, 2]}


class Search:
    """Best rows of a block of anchors inside each one's windows, over any number of trees."""

    def __init__(self, block: dict[str, np.ndarray], space: Space, same: bool, k: int):
        self.q, self.label, self.id, self.lo, self.hi = (block[n] for n in ("v", "label", "id", "lo", "hi"))
        self.q2, self.space, self.same, self.k = (self.q ** 2).sum(1), space, same, k
        self.best = np.full((*self.lo.shape, k), -np.inf)  # ascending; the first is what a row must reach
        self.found: list[tuple] = []
        self.held, self.room = 0, FOUND

    def open(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors ``who`` for which something between ``low`` and ``high`` (both per anchor) may still count."""
        need = np.maximum(self.lo[who], self.best[who, :, 0])
        return ((high[:, None] >= need) & (low[:, None] <= self.hi[who])).any(1)

    def visit(self, tree: dict[str, np.ndarray]) -> None:
        heap, n = [], 0

        def offer(node, who, low, high):
            nonlocal n
            if len(who):
                heapq.heappush(heap, (-float(high.max()), n, node, who, low, high))
                n += 1

        def expand(kids, who):
            low, high = self.space.bounds(self.q2[who], self.q[who] @ tree["centers"][kids].T, tree["radius"][kids])
            for j, node in enumerate(kids):
                still = self.open(who, low[:, j], high[:, j])
                offer(node, who[still], low[still, j], high[still, j])

        expand(np.array([0]), np.arange(len(self.q)))
        while heap:
            _, _, node, who, low, high = heapq.heappop(heap)
            still = self.open(who, low, high)
            who = who[still]
            if not len(who):
                continue
            begin, end = tree["kids"][node]
            if begin < end:
                expand(np.arange(begin, end), who)
            else:
                self.verify(tree, who, *tree["span"][node])

    def verify(self, tree: dict[str, np.ndarray], who: np.ndarray, begin: int, end: int) -> None:
        lo, hi = np.searchsorted(tree["at"], [begin, end])
        label, ids = tree["label"][lo:hi], tree["id"][lo:hi]
        score = (self.q[who] @ tree["points"][begin:end].T)[:, tree["at"][lo:hi] - begin]
        right = (label[None] == self.label[who, None]) == self.same
        if self.same:
            right &= ids[None] != self.id[who, None]
        for w in range(self.lo.shape[1]):
            need = np.maximum(self.lo[who, w], self.best[who, w, 0])
            fits = right & (score >= need[:, None]) & (score <= self.hi[who, w, None])
            some = fits.any(1)
            if not some.any():
                continue
            mine = who[some]
            held = np.concatenate([self.best[mine, w], np.where(fits[some], score[some], -np.inf)], 1)
            self.best[mine, w] = np.partition(held, held.shape[1] - self.k, axis=1)[:, -self.k:].copy()
            self.best[mine, w] = np.sort(self.best[mine, w], 1)
            r, c = np.nonzero(fits & (score >= self.best[who, w, :1]))
            self.found.append((who[r].astype(np.int32), np.full(len(r), w, np.int32), score[r, c], ids[c]))
            self.held += len(r)
        if self.held > self.room:
            self.found = [self.results()]
            self.held = len(self.found[0][0])
            self.room = FOUND + 2 * self.held

    def results(self) -> tuple[np.ndarray, ...]:
        """Anchor, window, score and id: the best k of every window and what ties with the last of them."""
        if not self.found:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        who, w, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        good = score >= self.best[who, w, 0]
        return who[good], w[good], score[good], ids[good]


def _smallest(a: np.ndarray) -> np.ndarray:
    """``a`` as whole numbers of fewer bytes where it holds no others."""
    if a.size and a.dtype.kind in "if" and (np.abs(a) < 1 << 31).all() and (a == np.floor(a)).all():
        return a.astype(np.promote_types(np.min_scalar_type(int(a.min())), np.min_scalar_type(int(a.max()))))
    return a


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{n}:{a.dtype.str}": _smallest(a) for n, a in arrays.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {n.partition(":")[0]: held[n].astype(n.partition(":")[2]) for n in held.files}


class Index:
    """Cover trees over all rows of ``vectors(vec_id, label, v, norm2)``; searches return at most ``keep`` rows a window."""

    def __init__(self, vectors: DataFrame, keep: int):
        facts = vectors.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max(F.size("v")).alias("width")).first()
        self.rows, self.width, self.space = facts["n"], max(1, facts["width"] or 0), Space(facts["top"] or 0.0)
        width, space, self.keep = self.width, self.space, keep
        if not self.rows:
            return
        by_hash = F.xxhash64("vec_id", "label", "v")
        sample = vectors.orderBy(by_hash, "vec_id").limit(SAMPLE).select("v").toArrow()  # bounded
        x = matrix(sample["v"], width)
        centers = x[space.net(x, CELLS)[0]]

        def to_cells(batches):
            for rb in batches:
                away = space.distances(matrix(rb.column("v"), width), centers)
                cell = np.argmin(away, 1)
                yield batch(["vec_id", "label", "v", "cell", "away"],
                            [rb.column("vec_id"), rb.column("label"), rb.column("v"), cell, away[np.arange(len(cell)), cell]],
                            [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64()])

        dealt = rewritten(vectors.select("vec_id", "label", "v").mapInArrow(
            to_cells, "vec_id long, label long, v array<double>, cell int, away double"))
        cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # CELLS rows at most
        self.cells = np.array([c["cell"] for c in cells])
        self.centers, self.radius = centers[self.cells], np.array([c["r"] for c in cells])
        room = max(1, BIN_NUMBERS // width)
        parts = {c["cell"]: -(-c["n"] // room) for c in cells}
        self.bins = sum(parts.values())
        cuts = F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centers))])
        binned = dealt.withColumn("bin", F.pmod(by_hash, F.element_at(cuts, F.col("cell") + 1)).cast("int"))

        def plant(table: pa.Table) -> pa.Table:
            tree = grow(matrix(table["v"], width), table["label"].to_numpy(), table["vec_id"].to_numpy(), space, keep)
            return pa.table({"cell": table["cell"][:1], "bin": table["bin"][:1], "tree": pa.array([_packed(**tree)], pa.binary())})

        self.trees = rewritten(binned.drop("away").groupBy("cell", "bin").applyInArrow(plant, "cell int, bin int, tree binary"))

    def search(self, anchors: DataFrame, count: int, same: bool, k: int) -> DataFrame:
        """``key``, ``w``, ``score``, ``vec_id``: rows among which are the best k of every window of ``anchors(key, vec_id, label, v, lo, hi)``.

        Of ``count`` anchors. lo and hi are arrays of equal size, a window each. ``same``: rows of the anchor's label but not
        of its id, else rows of other labels. Equal scores at the end of a window are all returned.
        """
        width, space = self.width, self.space
        centers, radius, cells = self.centers, self.radius, self.cells
        blocks = max(1, -(-count * width // BLOCK_NUMBERS))
        tasks = TASKS * int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = max(1, min(self.bins // SHARE, tasks // blocks))

        def pack(table: pa.Table) -> pa.Table:
            side = lambda name: matrix(table[name], windows)
            windows = max(1, int(np.max(table["lo"].combine_chunks().value_lengths().to_numpy())))
            sizes = table["lo"].combine_chunks().value_lengths().to_numpy()
            none = np.arange(windows)[None] >= sizes[:, None]
            lo, hi = side("lo"), side("hi")
            lo[none], hi[none] = np.inf, -np.inf
            data = _packed(key=table["key"].to_numpy(), id=table["vec_id"].to_numpy(), label=table["label"].to_numpy(),
                           v=matrix(table["v"], width), lo=lo, hi=hi)
            return pa.table({"block": table["block"][:1], "anchors": pa.array([data], pa.binary())})

        packed = rewritten(anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
                           .groupBy("block").applyInArrow(pack, "block int, anchors binary"))

        def visits(batches):
            for rb in batches:
                for block, data in zip(rb.column("block").to_pylist(), rb.column("anchors").to_pylist(), strict=True):
                    look = Search(_unpacked(data), space, same, k)
                    who = np.arange(len(look.q))
                    low, high = space.bounds(look.q2, look.q @ centers.T, radius)
                    for j, cell in enumerate(cells.tolist()):
                        still = look.open(who, low[:, j], high[:, j])
                        if still.any():
                            yield batch(["block", "cell", "hope"], [[block], [cell], [float(high[still, j].max())]],
                                        [pa.int32(), pa.int32(), pa.float64()])

        units = (packed.mapInArrow(visits, "block int, cell int, hope double").join(self.trees.select("cell", "bin"), "cell")
                 .withColumn("share", F.pmod(F.xxhash64("cell", "bin"), F.lit(shares)).cast("int")))
        # a block goes before its trees as a row of its own: not beside each of them, nor into a join, whose side Spark might take for small
        copies = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(float("inf")).alias("hope"),
                               F.lit(-1).alias("cell"), F.lit(-1).alias("bin"), F.col("anchors").alias("data"))
        work = (copies.unionByName(units.join(self.trees, ["cell", "bin"])
                                   .select("block", "share", "hope", "cell", "bin", F.col("tree").alias("data")))
                .repartition(min(2 * blocks * shares, tasks), "block", "share")
                .sortWithinPartitions("block", "share", F.desc(F.col("cell") < 0), F.desc("hope"), "cell", "bin"))

        def run(batches):
            look, keys = None, None

            def rows():
                who, w, score, ids = look.results()
                return batch(["key", "w", "score", "vec_id"], [keys[who], w, score.astype(np.int64), ids],
                             [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

            for rb in batches:
                cell, data = rb.column("cell"), rb.column("data")
                for i in range(rb.num_rows):
                    held = _unpacked(data[i].as_py())
                    if cell[i].as_py() >= 0:
                        look.visit(held)
                        continue
                    if look is not None:
                        yield rows()
                    look, keys = Search(held, space, same, k), held["key"]
            if look is not None:
                yield rows()

        return work.select("cell", "data").mapInArrow(run, "key long, w int, score long, vec_id long")


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label",
                   vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every row that ``anchors`` marks.

    A vector counts by floor(scale * x) of its components, a score is the inner product of two of them; higher scores come first, ties by
    the smaller id. Positives are the anchor's first ``positives`` other rows of its label (by id); negatives the first ``negatives`` rows of
    other labels with low * positive score <= 100 * score <= high * positive score. Rows with a null id, label or
    vector, or a null or non-finite component, take no part. Shorter vectors end in zeros. Rows that repeat id, label and
    vector count once. A positive without negatives, and an anchor without positives, has no rows; an empty table gives
    none. Scores are exact while sums of squares stay below 2**53. Other columns are not read.
    """
    small_batches(rows.sparkSession)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    wanted = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                         F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = wanted.where("vec_id is not null and label is not null and v is not null").select("vec_id", "label", "anchor", "v")
    vectors = rewritten(whole.mapInArrow(_quantized(scale), "vec_id long, label long, anchor boolean, v array<double>, norm2 double"))
    chosen = rewritten(vectors.where("anchor").dropDuplicates(["vec_id", "label", "v"])
                       .select(F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", "v"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    count = chosen.count()
    index = Index(vectors, max(positives + 1, negatives))
    if not count:
        return rows.sparkSession.createDataFrame([], schema)

    def first(found: DataFrame, by: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    everywhere = chosen.withColumns({"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))})
    liked = rewritten(first(index.search(everywhere, count, True, positives), ["key"], positives)
                      .select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = liked.groupBy("key").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most ``positives``
    # whole numbers s with low * p <= 100 * s <= high * p
    windows = rewritten(chosen.join(scores, "key").select(
        "*", F.transform("scores", lambda p: F.ceil(low * p / 100).cast("double")).alias("lo"),
        F.transform("scores", lambda p: F.floor(high * p / 100).cast("double")).alias("hi")))
    found = first(index.search(windows.drop("scores"), count, False, negatives), ["key", "w"], negatives)
    per_score = windows.select("key", F.col("vec_id").alias("anchor_id"), F.posexplode("scores").alias("w", "positive_score"))
    return (found.select("key", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(per_score, ["key", "w"]).join(liked, ["key", "positive_score"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
