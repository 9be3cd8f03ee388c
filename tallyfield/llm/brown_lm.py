"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Words are 64-bit hashes. A *unit* is what clustering moves between classes: a word whose share of the training tokens is
at least 1 / ``UNIT_SHARE`` (at most that many words, whatever the corpus), or one of ``TAIL_UNITS`` groups of all rarer words by length and last bytes;
the end of a text is a unit too. Texts become unit sequences once; each exchange pass maps them to
classes and counts, for every unit, the classes before and behind it. These tables have units x classes cells; tasks sum
theirs before they are shuffled, and the driver moves each unit to the class that raises the class bigram likelihood most.

log10 P(text) = sum of log10 [ P(class | class before) P(word | class) ]: transitions are interpolated with the classes' own shares,
emissions are counts plus ``DELTA`` with one more ``DELTA`` for unseen words. Counts of words that are too rare to be sent to
every task are joined by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, rewritten, slices, small_batches, text_array
from tallyfield.llm.words import Words, words_of

CLASSES = 48
UNIT_SHARE = 1 << 14
TAIL_UNITS = 1 << 11
#: Words with at least this share of the tokens are sent to the tasks with their counts.
HEAD_SHARE = 1 << 20
PASSES = 6
DELTA = 0.5
MIXED = 0.9
_TOKENS = 1 << 22
_BLOCK = 512


def tail_units(w: Words) -> np.ndarray:
    """Group of every word by its length and last two bytes, from 1 on."""
    if not len(w.ends):
        return np.empty(0, np.int64)
    last = w.data[w.ends - 1].astype(np.int64)
    one = w.data[np.maximum(w.ends - 2, w.starts)].astype(np.int64)
    return 1 + (np.minimum(w.ends - w.starts, 12) * 31 + last * 7 + one * 113 + (one >> 5) * 5) % TAIL_UNITS


class Units:
    """Units of words: 0 is the end of a text, then the tail groups, then the common words by hash."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.count = 1 + TAIL_UNITS + len(common)

    def of(self, w: Words) -> np.ndarray:
        unit = tail_units(w)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, w.hashes), len(self.common) - 1)
            hit = self.common[at] == w.hashes
            unit[hit] = 1 + TAIL_UNITS + at[hit]
        return unit


def _count_words(batches):
    """word, its tail group and count, summed over up to ``_TOKENS`` tokens of a task before they leave it."""
    words: list[np.ndarray] = []
    groups: list[np.ndarray] = []
    size = 0

    def out():
        values, at, counts = np.unique(np.concatenate(words), return_index=True, return_counts=True)
        return batch(["word", "tail", "n"], [values.view(np.int64), np.concatenate(groups)[at], counts],
                     [pa.int64(), pa.int16(), pa.int64()])

    for rb in batches:
        texts = text_array(rb.column("text"))
        for lo, hi in slices(texts):
            w = words_of(texts[lo:hi])
            words.append(w.hashes)
            groups.append(tail_units(w).astype(np.int16))
            size += len(w.hashes)
            if size >= _TOKENS:
                yield out()
                words, groups, size = [], [], 0
    if size:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    return (docs.select("text").mapInArrow(_count_words, "word long, tail short, n long").groupBy("word")
            .agg(F.max("tail").alias("tail"), F.sum("n").alias("n")))


def _sequences(units: Units):
    def run(batches):
        for rb in batches:
            texts = text_array(rb.column("text"))
            for lo, hi in slices(texts, 1 << 18):
                w = words_of(texts[lo:hi])
                # the texts of a slice in one sequence, each with its end
                both = np.insert(units.of(w), w.first[1:], 0).astype("<u2")
                yield batch(["units"], [[both.tobytes()]], [pa.binary()])
    return run


def _contexts(classes: np.ndarray, count: int):
    """Blocks of the table unit x (class before, class behind), summed over a task."""
    def run(batches):
        total = np.zeros((-(-count // _BLOCK) * _BLOCK, 2 * CLASSES), np.int64)
        for rb in batches:
            held = rb.column("units").to_pylist()
            for lo in range(0, len(held), 32):
                unit = np.frombuffer(b"".join(held[lo:lo + 32]), "<u2").astype(np.int64)
                c = classes[unit].astype(np.int64)
                before = np.concatenate([c[-1:], c[:-1]])  # sequences end with the end of a text, and begin behind one
                behind = np.append(c[1:], -1)
                total += np.bincount(unit * 2 * CLASSES + before, minlength=total.size).reshape(total.shape)
                inner = behind >= 0
                inner &= unit != 0  # what follows an end is the next text
                total += np.bincount(unit[inner] * 2 * CLASSES + CLASSES + behind[inner], minlength=total.size).reshape(total.shape)
        for b in range(0, len(total), _BLOCK):
            part = total[b:b + _BLOCK]
            if part.any():
                yield batch(["block", "table"], [[b], [part.tobytes()]], [pa.int64(), pa.binary()])
    return run


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["table"].to_pylist())
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "table": pa.array([total.tobytes()], pa.binary())})


def context_table(sequences: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    """units x (CLASSES before + CLASSES behind) counts; at most UNIT_SHARE + TAIL_UNITS + 1 rows."""
    parts = sequences.mapInArrow(_contexts(classes, count), "block long, table binary")
    rows = parts.groupBy("block").applyInArrow(_sum_blocks, "block long, table binary").collect()
    out = np.zeros((-(-count // _BLOCK) * _BLOCK, 2 * CLASSES), np.int64)
    for r in rows:
        out[r["block"]:r["block"] + _BLOCK] = np.frombuffer(r["table"], np.int64).reshape(_BLOCK, 2 * CLASSES)
    return out[:count]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(pairs: np.ndarray) -> float:
    """Class part of the bigram log-likelihood: sum n(c, d) log n(c, d) - 2 sum n(c) log n(c)."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(1)).sum() - _xlogx(pairs.sum(0)).sum())


def class_pairs(table: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of (class before, class) from the units' contexts."""
    out = np.zeros((CLASSES, CLASSES))
    np.add.at(out.T, classes, table[:, :CLASSES])
    return out


def exchange(table: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One sweep: every unit in turn, the most frequent first, goes to the class that is best for it.

    Moving unit u from c to d changes the rows and columns of c and d of the pair counts by u's contexts; the gain is the change of
    the likelihood with the contexts as they were counted. A class never loses its last unit; the end of a text stays alone.
    """
    classes, pairs = classes.copy(), class_pairs(table, classes)
    members = np.bincount(classes, minlength=CLASSES)
    every = np.arange(CLASSES)
    for u in np.argsort(-table[:, :CLASSES].sum(1), kind="stable"):
        c, n = classes[u], table[u, :CLASSES].sum()
        if u == 0 or not n or members[c] == 1:
            continue
        before, behind = table[u, :CLASSES].astype(float), table[u, CLASSES:].astype(float)
        rest = pairs.copy()
        rest[:, c] -= before
        rest[c, :] -= behind
        np.maximum(rest, 0, out=rest)
        # add the unit to each class d: column d gains ``before``, row d gains ``behind``
        column = (_xlogx(rest + before[:, None]) - _xlogx(rest)).sum(0)
        row = (_xlogx(rest + behind[None, :]) - _xlogx(rest)).sum(1)
        into, out = rest.sum(0), rest.sum(1)
        gain = column + row - (_xlogx(into + n) - _xlogx(into)) - (_xlogx(out + behind.sum()) - _xlogx(out))
        gain[0] = -np.inf
        d = int(every[np.argmax(gain)])
        if d != c and gain[d] > gain[c] + 1e-9:
            pairs = rest
            pairs[:, d] += before
            pairs[d, :] += behind
            members[c] -= 1
            members[d] += 1
            classes[u] = d
        # else the pairs stay as they were
    return classes


def first_classes(sizes: np.ndarray) -> np.ndarray:
    """The end alone in class 0; the other units by falling size in turn over the other classes."""
    classes = np.zeros(len(sizes), np.int64)
    order = 1 + np.argsort(-sizes[1:], kind="stable")
    classes[order] = 1 + np.arange(len(order)) % (CLASSES - 1)
    return classes


def cluster(sequences: DataFrame, units: Units, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Classes of the units, (class before, class) counts and the likelihood; of all passes the best."""
    ones = np.zeros(units.count, np.int64)
    sizes = context_table(sequences, ones, units.count)[:, :CLASSES].sum(1)
    classes, best = first_classes(sizes), None
    for k in range(passes + 1):
        table = context_table(sequences, classes, units.count)
        pairs = class_pairs(table, classes)
        value = likelihood(pairs)
        if best is None or value > best[2]:
            best = (classes, pairs, value)
        if k < passes:
            moved = exchange(table, classes)
            # all units moved on the same contexts: move every other one only, so that partners don't swap for ever
            half = (np.arange(units.count) + k) % 2 == 0 if k else np.ones(units.count, bool)
            classes = np.where(half, moved, classes)
    return best


def transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), interpolated with the classes' shares; every class has a share above zero."""
    own = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    rows = pairs.sum(1, keepdims=True)
    seen = np.where(rows > 0, pairs / np.maximum(rows, 1), own)
    return np.log10(MIXED * seen + (1 - MIXED) * own)


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                    passes: int = PASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows where ``held_out`` (a condition on the row) is false and scores all. Tokens are the words and one end per text, so a null or
    empty text has one token. base_score is the add-one unigram score. With nothing to learn from, all words are unseen:
    the scores follow from the smoothing alone. Rows that repeat a doc_id are scored each; an empty table gives
    no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out")
    counts = rewritten(word_counts(train))
    ends = train.count()
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds, tokens = kinds + (ends > 0), tokens + ends
    head = counts.where(F.col("n") * HEAD_SHARE >= max(tokens, 1)).toPandas()  # at most HEAD_SHARE rows
    order = np.argsort(head["word"].to_numpy(np.int64).view(np.uint64))
    words, seen = head["word"].to_numpy(np.int64).view(np.uint64)[order], head["n"].to_numpy(np.int64)[order]
    units = Units(words[seen * UNIT_SHARE >= max(tokens, 1)])
    sequences = rewritten(train.select("text").mapInArrow(_sequences(units), "units binary"))
    classes, pairs, _ = cluster(sequences, units, passes)
    moves = transitions(pairs)
    in_class = pairs.sum(0)
    # distinct words of each class: units are words but for the tail groups, whose words come with the counts
    kinds_in = np.bincount(classes[1 + TAIL_UNITS:], minlength=CLASSES).astype(float)
    kinds_in[0] += 1
    rare_kinds = counts.where(F.col("n") * UNIT_SHARE < max(tokens, 1)).groupBy("tail").agg(F.count("*").alias("n"))
    for r in rare_kinds.collect():  # a row per tail group
        kinds_in[classes[r["tail"]]] += r["n"]
    mass = in_class + DELTA * (kinds_in + 1)
    log_mass = np.log10(np.maximum(mass, DELTA))
    base_all = math.log10(tokens + kinds + 1)

    def run(batches):
        for rb in batches:
            texts, ids, held = text_array(rb.column("text")), rb.column("doc_id"), rb.column("held_out")
            for lo, hi in slices(texts):
                w = words_of(texts[lo:hi])
                unit = units.of(w)
                c = classes[unit]
                n = hi - lo
                row = np.repeat(np.arange(n), np.diff(w.first))
                at = np.minimum(np.searchsorted(words, w.hashes), max(len(words) - 1, 0))
                common = words[at] == w.hashes if len(words) else np.zeros(len(w.hashes), bool)
                count = seen[at] if len(words) else np.zeros(len(w.hashes))
                before = np.zeros(len(c), np.int64)
                before[1:] = c[:-1]
                before[w.first[:-1][w.first[:-1] < w.first[1:]]] = 0  # a text begins behind an end
                last = np.where(np.diff(w.first) > 0, c[np.maximum(w.first[1:] - 1, 0)] if len(c) else 0, 0)
                score = moves[before, c] - log_mass[c]
                score[common] += np.log10(count[common] + DELTA)
                base = np.where(common, np.log10(np.where(common, count, 0) + 1), 0.0)
                total = np.bincount(row, score, n) + moves[last, 0] + (math.log10(ends + DELTA) - log_mass[0])
                plain = np.bincount(row, base, n) + math.log10(ends + 1) - base_all * (np.diff(w.first) + 1)
                yield batch(["doc_id", "held_out", "row", "word", "n_tokens", "n_known", "base_score", "score", "n"],
                            [ids[lo:hi], held[lo:hi], _row_names(ids, lo, hi, texts), pa.nulls(n, pa.int64()), np.diff(w.first) + 1,
                             np.bincount(row, common, n).astype(np.int64) + (ends > 0), plain, total, pa.nulls(n, pa.int64())], _TYPES)
                rare = np.flatnonzero(~common)
                if len(rare):
                    by = np.lexsort((w.hashes[rare], row[rare]))
                    h, r = w.hashes[rare][by], row[rare][by]
                    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
                    times = np.diff(np.append(cut, len(h)))
                    m, place = len(cut), pa.array(r[cut] + lo)
                    yield batch(["doc_id", "held_out", "row", "word", "n_tokens", "n_known", "base_score", "score", "n"],
                                [ids.take(place), held.take(place), _row_names(ids, lo, hi, texts)[r[cut]], h[cut].view(np.int64),
                                 pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), times], _TYPES)

    parts = rewritten(rows.mapInArrow(run, "doc_id long, held_out boolean, row long, word long, n_tokens long, n_known long, "
                                           "base_score double, score double, n long"))
    own = parts.where("word is null").select("doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", F.lit(1).alias("copies"))
    joined = (parts.where("word is not null").select("doc_id", "held_out", "row", "word", F.col("n").alias("times"))
              .join(counts.select("word", F.col("n").alias("c")), "word", "left"))
    c = F.coalesce("c", F.lit(0))
    rare = joined.select("doc_id", "held_out", "row", F.lit(0).alias("n_tokens"),
                         F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"),
                         (F.col("times") * F.log10(c + 1)).alias("base_score"),
                         (F.col("times") * F.log10(c + F.lit(DELTA))).alias("score"), F.lit(0).alias("copies"))
    sums = own.unionByName(rare).groupBy("doc_id", "held_out", "row").agg(
        *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score", "copies")])
    # equal rows fell together: their sums are shared out again
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "held_out", *[(F.col(x) / F.col("copies")).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return each.select("doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
                       F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]


def _row_names(ids, lo: int, hi: int, texts) -> np.ndarray:
    """A name for each row's text, so that rows that share a doc_id but not a text stay apart."""
    import zlib

    return np.array([zlib.crc32(x.as_buffer()) for x in texts[lo:hi]], np.int64)
