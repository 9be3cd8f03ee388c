"""Best-fit packing from a configuration linear program.

Documents are tokenized once; of a piece only its length and checksum go on. The histogram of piece lengths has at most
``capacity`` entries whatever the table's size. On it the configuration LP (as few sequences as possible, each filled by a pattern
of lengths) is solved by multiplicative weights: lengths that earlier patterns covered little weigh more, and a
knapsack dynamic program prices the best next pattern. Whole copies of the LP's patterns are kept; what rounding leaves is
best-fit packed, again on the histogram. Pieces then take the places of their length by rank; ranks come from
counts per (length, hash bucket), so that a length with a third of all pieces is ranked in many tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, rewritten, slices, text_array, texts_of
from tallyfield.llm.word_ids import encode

#: Pieces that one rank window holds, about.
RANKED = 20_000


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for rb in batches:
            texts, ids = text_array(rb.column("text")), rb.column("doc_id")
            for lo, hi in slices(texts, 1 << 22):
                row, piece, start, length, crc = [], [], [], [], []
                for r, body in enumerate(encode(texts[lo:hi].to_pylist(), path)):
                    body += end
                    n = len(body) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        row.append(lo + r)
                        piece.append(k)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        crc.append(zlib.crc32(body[4 * at:4 * (at + capacity)]))
                yield batch(["doc_id", "piece", "start", "length", "ids_crc32"],
                            [ids.take(pa.array(row, pa.int64())), piece, start, length, crc],
                            [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])
    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with ``end_id`` behind, cut every ``capacity``."""
    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_pieces(vocabulary, capacity, end_id),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """Dearest patterns of at most ``capacity`` tokens at given prices, by dynamic programming over the tokens."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int):
        self.sizes, self.prices, self.capacity = lengths, prices, capacity
        self.worth, self.last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")  # lengths ascend
        for c in range(1, capacity + 1):
            self.worth[c] = self.worth[c - 1]
            if fits[c]:
                gain = self.worth[c - lengths[:fits[c]]] + prices[:fits[c]]
                k = int(np.argmax(gain))
                if gain[k] > self.worth[c]:
                    self.worth[c], self.last[c] = gain[k], k

    def pattern(self, first: int) -> np.ndarray:
        """Copies of each length in the dearest pattern that holds length ``first``."""
        counts = np.zeros(len(self.sizes), np.int64)
        counts[first], c = 1, self.capacity - int(self.sizes[first])
        while c > 0:
            k = self.last[c]
            if k < 0:
                c -= 1
            else:
                counts[k] += 1
                c -= int(self.sizes[k])
        return counts

    def near_best(self, slack: float, taken: np.ndarray):
        """Patterns within ``slack`` of the dearest one's price, the dearest first, by a first length not ``taken`` yet."""
        total = self.prices + self.worth[self.capacity - self.sizes]
        for k in np.argsort(-total, kind="stable"):
            if total[k] < (1 - slack) * total.max():
                return
            if not taken[k]:
                yield self.pattern(int(k))


def solve_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 100,
                         step: float = 0.5) -> list[tuple[np.ndarray, int]]:
    """Patterns with the whole number of times that each is used; together they never exceed ``demand``.

    Multiplicative weights for the covering LP, in the form whose steps do not depend on its width: a length's price is its
    size times exp(-covered share / step). Each round prices all lengths by one knapsack and uses its near-best patterns
    that share no length, each until its scarcest length has gained ``step`` of its demand. The uses, scaled so that no
    length is covered more than demanded, are rounded down. Work depends on the histogram alone.
    """
    patterns: dict[bytes, list] = {}
    covered = np.zeros(len(lengths))
    while rounds and len(lengths) and covered.min() < 1:
        rounds -= 1
        prices = lengths * np.exp(-(covered - covered.min()) / step)
        taken = np.zeros(len(lengths), bool)
        for counts in Knapsack(prices, lengths, capacity).near_best(step, taken):
            used = np.flatnonzero(counts)
            if taken[used].any() or (counts[used] > demand[used]).any():
                continue
            taken[used] = True
            times = step * float(np.min(demand[used] / counts[used]))
            covered[used] += times * counts[used] / demand[used]
            patterns.setdefault(counts.tobytes(), [counts, 0.0])[1] += times
        if not taken.any():
            break  # the prices would stay as they are
    # a pattern's share that the fullest of its lengths allows
    left, out = demand.copy(), []
    for counts, times in patterns.values():
        used = counts > 0
        scaled = times / max(1.0, float(covered[used].max()))
        whole = min(int(scaled + 1e-9), int(np.min(left[used] // counts[used])))
        if whole:
            left -= whole * counts
            out.append((counts, whole))
    return out


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on a histogram: fill one sequence from the longest pieces down, always with the longest that
    still fits, and use the pattern as often as the pieces allow. Each step uses up a length at least."""
    order = np.argsort(-lengths)
    sizes, left = lengths[order], demand[order].copy()
    out = []
    while left.any():
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(left):
            if sizes[k] <= room:
                counts[k] = min(int(left[k]), int(room // sizes[k]))
                room -= int(counts[k] * sizes[k])
                if not room:
                    break
        used = counts > 0
        times = int(np.min(left[used] // counts[used]))
        left -= times * counts
        back = np.empty_like(counts)
        back[order] = counts
        out.append((back, times))
    return out


@dataclass(frozen=True)
class Places:
    """For every length, runs of places: rank ``first`` on, in sequence ``sequence`` on, at ``offset``."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def lay_out(lengths: np.ndarray, used: list[tuple[np.ndarray, int]]) -> Places:
    """Number the sequences pattern by pattern and the places of each length in the same order."""
    taken = np.zeros(len(lengths), np.int64)
    key, sequence, offset, base = [], [], [], 0
    for counts, times in used:
        at = 0
        for k in np.flatnonzero(counts):
            for _ in range(int(counts[k])):
                key.append((int(lengths[k]) << 44) + int(taken[k]))
                sequence.append(base)
                offset.append(at)
                taken[k] += times
                at += int(lengths[k])
        base += times
    order = np.argsort(np.array(key, np.int64))
    pick = lambda x: np.array(x, np.int64)[order]
    return Places(pick(key), pick(sequence), pick(offset), base)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (length at most ``capacity``) with sequence_id and offset: gapless from 0 within each sequence.

    Equal lengths are dealt by a hash of doc_id and piece, so retried tasks repeat their places; rows that repeat both are
    dealt in any order, which changes no sequence's fill. An empty table gives no rows.
    """
    pieces = rewritten(pieces)
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()  # <= capacity rows
    lengths, demand = histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    used = solve_configurations(lengths, demand, capacity)
    left = demand - sum((counts * times for counts, times in used), np.zeros(len(demand), np.int64))
    places = lay_out(lengths, used + best_fit(lengths, left, capacity))
    buckets = max(1, int(demand.sum()) // RANKED)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(F.xxhash64("piece", "doc_id"), "doc_id", "piece")
    ranked = (dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")))

    def place(batches):
        for rb in batches:
            length, rank = rb.column("length").to_numpy(), rb.column("rank").to_numpy()
            at = np.searchsorted(places.key, (length << 44) + rank, "right") - 1
            yield batch(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                        [*(rb.column(i) for i in range(5)),
                         places.sequence[at] + rank - (places.key[at] & ((1 << 44) - 1)), places.offset[at]],
                        [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places. A null or empty text is ``end_id`` alone; rows that repeat a doc_id
    are packed each; other columns are not read."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity)
