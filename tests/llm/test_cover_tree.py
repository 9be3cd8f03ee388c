"""Hard negatives against all pairs, and the bounds of the tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import cover_tree

SCHEMA = "vec_id long, label int, embedding array<float>, key string, v int, score double"


def brute(rows, anchors, positives=5, negatives=10):
    ok = {(i, int(lb), tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lb, v in rows
          if None not in (i, lb, v) and all(x is not None and math.isfinite(x) for x in v)}
    out, dot = [], lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    for i, lb, v in ok:
        if not anchors(i):
            continue
        others = [(-dot(v, u), j, m) for j, m, u in ok if j != i or m != lb]
        pos = sorted((s, j) for s, j, m in others if m == lb)[:positives]
        for s, j in pos:
            neg = sorted((t, k) for t, k, m in others if m != lb and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(neg)]
    return sorted(out)


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        x = middles[rng.integers(6)] + 0.3 * rng.normal(size=8)
        if i % 3 == 0:
            x = middles[0]  # a vector that a third of all rows share
        rows.append((int(i), int(rng.integers(4)), [float(t) for t in x * rng.choice([0.1, 1, 3])]))
    return rows


def run(spark, rows, anchors):
    df = spark.createDataFrame([(*r, "k", 1, 0.5) for r in rows], SCHEMA)
    return sorted(map(tuple, cover_tree.hard_negatives(df, anchors).collect()))


@pytest.mark.parametrize("numbers,fanout,leaf", [(1 << 17, 32, 64), (400, 3, 2)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, numbers, fanout, leaf):
    monkeypatch.setattr(cover_tree, "BIN_NUMBERS", numbers)
    monkeypatch.setattr(cover_tree, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(cover_tree, "FANOUT", fanout)
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "CELLS", 7)
    rows = vectors(4)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and run(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_rows_that_take_no_part_short_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 1, [0.9, 0.1, 0.3]), (3, 2, [0.5, 0.2]), (4, 2, [0.5, 0.2]), (5, 2, []),
            (6, None, [1.0]), (None, 2, [0.5]), (7, 2, None), (8, 2, [nan, 1.0]), (9, 2, [0.5, None]), (11, 2, [inf]), (12, 2, [-inf]), (20, 3, [9.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert {r[3] for r in want} == {3, 4} and run(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_tables_without_rows_or_anchors(spark):
    assert run(spark, [], F.lit(True)) == [] and run(spark, [(1, 1, [1.0]), (2, 2, [1.0])], F.col("vec_id") > 5) == []
    assert run(spark, [(1, 1, [0.0]), (2, 1, [0.0]), (3, 2, [0.0])], F.col("vec_id") == 1) == [(1, 2, 1, 3, 0, 0)]


def test_nodes_cover_and_bound_what_is_below(spark):
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 4)) * rng.choice([0.2, 1], size=(500, 1)))
    space = cover_tree.Space(float((x * x).sum(1).max()))
    tree = cover_tree.grow(x, np.zeros(500, np.int64), np.arange(500), space, 5)
    q = np.floor(256 * rng.normal(size=(9, 4)))
    low, high = space.bounds((q * q).sum(1), q @ tree["centers"].T, tree["radius"])
    skipped = 0
    for node, (begin, end) in enumerate(tree["span"]):
        inner = q @ tree["points"][begin:end].T
        assert (low[:, node] <= inner.min(1)).all() and (high[:, node] >= inner.max(1)).all()
        away = space.distances(tree["points"][begin:end], tree["centers"][node:node + 1])
        assert away.max() <= tree["radius"][node] + 1e-3
        skipped += (high[:, node] < 0.5 * (q @ x.T).max(1)).sum()
    assert skipped > 0 and sorted(tree["id"]) == list(range(500))


def test_anchors_are_not_broadcast_and_tasks_do_not_grow_with_the_bins(spark, monkeypatch):
    import re

    monkeypatch.setattr(cover_tree, "BIN_NUMBERS", 8)
    monkeypatch.setattr(cover_tree, "CELLS", 1)
    rows = spark.createDataFrame([(i, i % 2, [float(i), 1.0] + [0.0] * 6, float(i * i + 1)) for i in range(150)],
                                 "vec_id long, label long, v array<double>, norm2 double")
    index = cover_tree.Index(rows, 3)
    anchors = rows.where("vec_id in (1, 2, 3)").selectExpr("vec_id as key", "vec_id", "label", "v", "array(-1e9D) as lo", "array(1e9D) as hi")
    found = index.search(anchors, 3, True, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(block#\d+, share#\d+, (\d+)\), REPARTITION", plan)]
    assert index.bins == 150 and len(dealt) == 1
    assert dealt[0] <= cover_tree.TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = plan.splitlines()
    exploded = next(i for i, x in enumerate(lines) if "Generate explode(" in x)
    above = [x for x in lines[:exploded] if "Union" in x or "BroadcastExchange" in x]
    assert above and "Union" in above[-1]
    best = {}
    for r in sorted(found.collect(), key=lambda r: -r.score):
        best.setdefault(r.key, []).append(r.vec_id)
    assert {k: v[:2] for k, v in best.items()} == {1: [149, 147], 2: [148, 146], 3: [149, 147]}


def test_found_rows_that_no_longer_count_are_let_go(monkeypatch):
    monkeypatch.setattr(cover_tree, "FOUND", 20)
    space = cover_tree.Space(1e6)
    block = {"v": np.array([[1.0]]), "label": np.array([0]), "id": np.array([-1]), "lo": np.array([[-np.inf]]), "hi": np.array([[np.inf]])}
    look = cover_tree.Search(block, space, True, 3)
    for k in range(200):  # ever better rows
        look.visit(cover_tree.grow(np.array([[float(k)]]), np.array([0]), np.array([k]), space, 3))
        assert sum(len(x[0]) for x in look.found) <= 27
    assert sorted(look.results()[3].tolist())[-3:] == [197, 198, 199]


def test_packed_arrays_come_back_as_they_were():
    held = {"v": np.array([[1.0, -300.0]]), "lo": np.array([[-np.inf, 2.0]]), "radius": np.array([0.5]), "points": np.array([[1e12]]),
            "id": np.array([1 << 40, -5]), "at": np.array([], np.int64), "some": np.array([3, 70_000])}
    back = cover_tree._unpacked(cover_tree._packed(**held))
    assert set(back) == set(held)
    assert all(back[n].dtype == a.dtype and back[n].shape == a.shape and (back[n] == a).all() for n, a in held.items())
    many = {"points": np.ones((2048, 64))}
    assert len(cover_tree._packed(**many)) < many["points"].nbytes // 4
