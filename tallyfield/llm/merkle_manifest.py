"""Merkle manifest of a table: leaves, subroots by group, one root, and proofs that are checked by folding.

A leaf is the SHA-256 of a row's fields. In each group leaves ascend by id; every FAN consecutive nodes (the last run may be
shorter) become their hash until one is left, the group's subroot; the subroots, in the order of their groups, become the root
in the same way.

Positions come from range partitions and their counts, so a group with a third of all rows is ranked in many
tasks. A tree is then climbed LEVELS levels at a time: rows of a block of FAN**LEVELS positions share a window,
on each level lag and lead columns of fixed offsets, masked by a node's slot and its run's length, give a node's
siblings, and the rows of first children hash the parents. Only one row a block goes on to the next climb. On the way down the
windows are taken again and a block's rows receive what stands above it by a join on (group, block), so no group is ever a hot key
and sibling lists never leave the task that uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import rewritten
from tallyfield.operators.ordering import with_range_bucket

#: Children of a node, and levels that one window climbs: a window holds FAN**LEVELS rows at most.
FAN, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenated UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in ascending ``order`` of the group) and ``n`` (the group's rows). ``group`` has no nulls.

    Rows that agree in group and order get neighbouring positions in any order.
    """
    dealt = with_range_bucket(rows, [group, *order], "_part")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    per_group = Window.partitionBy(group)
    shifts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"),
                           (F.sum("_rows").over(per_group.orderBy("_part")) - F.col("_rows")).alias("_before"),
                           F.sum("_rows").over(per_group).alias("n"))
    local = Window.partitionBy(group, "_part").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(local) - 1)
    return (ranked.join(shifts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_rank") + F.col("_before")).drop("_g", "_p", "_part", "_rank", "_before"))


def _climb(nodes: DataFrame) -> DataFrame:
    """``nodes(g, pos, n, h, ...)`` with ``block``, ``path`` (siblings on each level of the block that has any nodes to join,
    from the lowest) and, on the block's first row, ``top`` (the block's hash)."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN ** LEVELS))
    span = Window.partitionBy("g", "block").orderBy("pos")
    below = span.rowsBetween(Window.unboundedPreceding, 0)
    at, steps = F.col("h"), []
    for level in range(LEVELS):
        step = FAN ** level
        node = F.floor(F.col("pos") / step)
        size = F.ceil(F.col("n") / step)  # nodes on this level
        slot = node % FAN
        run = F.least(F.lit(FAN), size - node + slot)
        here, joins = F.col("pos") % step == 0, size > 1
        rows = rows.withColumn("_h", F.when(here, at))
        left = [F.when(slot >= k, F.lag("_h", k * step).over(span)) for k in range(FAN - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("_h", k * step).over(span)) for k in range(1, FAN)]
        rows = rows.withColumns({"_left": F.concat_ws("", *left), "_right": F.concat_ws("", *right)})
        first = here & (slot == 0)
        rows = rows.withColumns({
            "_up": F.when(first, F.when(joins, digest(F.col("_h"), F.col("_right"))).otherwise(F.col("_h"))),
            f"_s{level}": F.when(here & joins, F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))})
        at = F.col("_up")
        # a row's ancestor on this level is the last node at or before it
        steps.append(F.when(joins, F.last(f"_s{level}", True).over(below)) if level else F.col("_s0"))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(_PATH)
    return rows.withColumns({"path": path, "top": at}).drop("_h", "_left", "_right", "_up", *[f"_s{i}" for i in range(LEVELS)])


class Trees:
    """The trees over ``leaves(g, pos, n, h, ...)``, one per ``g``."""

    def __init__(self, leaves: DataFrame):
        self.levels = [rewritten(leaves)]
        while True:
            heads = rewritten(_climb(self.levels[-1]).where("top is not null").select("g", "block", "n", "top"))
            if (heads.agg(F.max("n")).first()[0] or 0) <= FAN ** LEVELS:
                break
            self.levels.append(heads.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / FAN ** LEVELS).alias("n"),
                                            F.col("top").alias("h")))
        #: ``g`` and the hash that remains of it.
        self.tops = heads.select("g", "top")

    def leaves(self, ends: DataFrame) -> DataFrame:
        """The leaves with ``path`` (siblings from the leaf to the top, then ``above``) and the other columns that ``ends(g, above, ...)`` has
        for their group."""
        heads = ends.withColumn("block", F.lit(0))
        kept = [c for c in ends.columns if c not in ("g", "above")]
        for level in range(len(self.levels) - 1, -1, -1):
            ahead = heads.withColumnsRenamed({"g": "_g", "block": "_b"})
            rows = (_climb(self.levels[level]).join(ahead, (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_b")))
                    .withColumn("path", F.concat("path", "above")).drop("_g", "_b", "above"))
            if level:
                heads = rewritten(rows.select("g", F.col("pos").alias("block"), F.col("path").alias("above"), *kept))
        return rows


def fold(leaf: Column, path: Column) -> Column:
    """The top that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` marks rows whose text has A-Z lower-cased before their leaf is hashed again (null: not marked); folded_root is what that leaf
    gives with the original siblings, verified whether it is the root. A null group is one of its own, before all others; null ids come first;
    rows that share an id follow each other by their leaves, so rows that repeat every field have one leaf and the proof of one of
    their places each. A null text stays null. An empty table gives no rows. Other columns are not read.
    """
    text = F.col(text_col)
    forged = F.translate(text, UPPER, LOWER)
    others = {f: field(F.col(f)) for f in fields}
    leaf = digest(*others.values())
    again = digest(*[field(forged) if f == text_col else c for f, c in others.items()])
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("g"), leaf.alias("h"),
                       F.when(tampered & (forged != text), again).alias("forged"))
    below = Trees(positions(rewritten(rows), "g", ["doc_id", "h"]))
    upper = below.tops.select(F.lit("").alias("one"), F.col("g").alias("name"), F.col("top").alias("h"))
    over = Trees(positions(upper, "one", ["name"]).withColumnRenamed("one", "g"))
    nothing = F.array().cast(_PATH).alias("above")
    ends = over.leaves(over.tops.select("g", nothing, F.col("top").alias("root"))).select(
        F.col("name").alias("g"), F.col("path").alias("above"), F.col("h").alias("subroot"), "root")
    whole = below.leaves(rewritten(ends)).select("doc_id", F.col("h").alias("leaf"), F.coalesce("forged", "h").alias("_again"),
                                                 "subroot", "root", F.col("path").alias("_path"))
    siblings = F.concat_ws("", F.flatten(F.transform("_path", lambda s: F.array(s["left"], s["right"]))))
    return whole.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                        fold(F.col("_again"), F.col("_path")).alias("folded_root")
                        ).withColumn("verified", F.col("folded_root") == F.col("root"))


