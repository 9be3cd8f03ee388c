"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning: log-odds of a token between toxic and clean labelled documents, with an informative Dirichlet prior
(``PRIOR`` pseudo-documents spread as the pooled counts), from document counts, so that one text which repeats a token proves no more
than one that holds it once. A token is a word or one of its byte prefixes (``PREFIXES``), since insults are inflected. Those whose
log-odds are ``Z`` standard errors above zero score; all other words cost ``DRIFT``.

Scoring: a left-to-right scan finds all maximal scoring segments in linear time. As the expected score of a clean
word is negative, the best segments of clean text follow an extreme-value law: with lambda the positive root of E[exp(lambda s)] = 1
over clean words and K fitted to the segments seen in clean texts, a segment of score S in n words is expected
K n exp(-lambda S) times by chance. The significant segments of a text are aggregated by the law of sums of the r best
(p = exp(-T) T^(r-1) / r! (r-1)!, T the sum of lambda S - ln K n), and Bayes' rule turns p into the score: the
share of toxic labels is the prior, 1 / (-e p ln p) the evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, rewritten, slices, text_array, texts_of
from tallyfield.llm.words import Words, span_hashes, words_of

PREFIXES = (4, 5, 6, 7, 8, 10, 12)
PRIOR = 100.0
Z = 4.0
DRIFT = 0.05
#: A token earns its log-odds less one standard error; below this it is no sign of toxicity.
LEAST = 1.0
#: Labelled rows that learning reads at most, chosen by a hash of their id.
TRAIN_ROWS = 50_000


@dataclass(frozen=True)
class ToxicModel:
    """Sorted token hashes with their scores; the law's lambda and K; share of toxic labels."""

    tokens: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    scale: float
    k: float
    prior: float


def tokens_of(w: Words):
    """Token hashes of every word: the word, then its prefixes (a word that is not longer stands for them)."""
    yield w.hashes
    for n in PREFIXES:
        yield span_hashes(w.data, w.starts, np.minimum(w.ends, w.starts + n)) ^ np.uint64(n)


def _document_tokens(batches):
    for rb in batches:
        texts, toxic = text_array(rb.column("text")), rb.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi in slices(texts):
            w = words_of(texts[lo:hi])
            row = np.repeat(np.arange(hi - lo), np.diff(w.first))
            flag = toxic[lo:hi] == 1
            seen = []
            for h in tokens_of(w):
                order = np.lexsort((row, h))
                h, r = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                seen.append((h[new], flag[r[new]]))
            h, f = (np.concatenate(x) for x in zip(*seen, strict=True))
            values, at = np.unique(h, return_inverse=True)
            yield batch(["token", "toxic", "clean"],
                        [values.view(np.int64), np.bincount(at, f, len(values)).astype(np.int64),
                         np.bincount(at, ~f, len(values)).astype(np.int64)], [pa.int64()] * 3)


def word_scores(w: Words, tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Largest weight among a word's tokens; 0 where none is known."""
    out = np.zeros(len(w.hashes))
    if not len(tokens):
        return out
    low = np.zeros(1 << 16, bool)
    low[(tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
    for h in tokens_of(w):
        maybe = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(tokens, h[maybe]), len(tokens) - 1)
        hit = tokens[at] == h[maybe]
        np.maximum.at(out, maybe[hit], weights[at[hit]])
    return out


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text whose words cost ``drift`` except at ``places``,
    where they earn ``scores`` > 0. Linear time: each candidate segment is merged into a later one at most once."""
    done: list[list[float]] = []  # start, end, total before the segment, total behind it
    total, before = 0.0, 0
    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (p - before)
        left, now = total, total + s
        total, before = now, p + 1
        piece = [p, p + 1, left, now]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= piece[2]:
                j = int(done[j][4])
            if j < 0 or done[j][3] >= piece[3]:
                done.append([*piece, j])
                break
            piece = [done[j][0], piece[1], done[j][2], piece[3]]
            del done[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in done]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", z: float = Z, drift: float = DRIFT) -> ToxicModel:
    """Learn from the ``labels`` rows (id, 0/1; others and unknown ids are left out), ``train_rows`` of them at most."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("label_id"), F.col(label_col).alias("toxic"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows).dropDuplicates(["label_id"]))
    # bounded by train_rows, so it may be sent to every executor
    sample = texts_of(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    sample = rewritten(sample.select("text", F.col("toxic").cast("int").alias("toxic")))
    n1, n0 = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    empty = ToxicModel(np.empty(0, np.uint64), np.empty(0), 1.0, 1.0, n1 / max(1, n0 + n1))
    if not n1 or not n0:
        return empty
    counts = (sample.mapInArrow(_document_tokens, "token long, toxic long, clean long").groupBy("token")
              .agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0")).where("y1 >= 3"))
    share = (F.col("y1") + F.col("y0")) / F.lit(float(n0 + n1)) * PRIOR
    odds = lambda y, n: F.log((F.col(y) + share) / (n + PRIOR - F.col(y) - share))
    scored = (counts.withColumn("w", odds("y1", n1) - odds("y0", n0))
              .withColumn("se", F.sqrt(1 / (F.col("y1") + share) + 1 / (F.col("y0") + share)))
              .where(F.col("w") > z * F.col("se")).select("token", (F.col("w") - F.col("se")).alias("w")).where(F.col("w") >= LEAST))
    got = scored.toPandas()  # tokens of a bounded sample, few of them significant
    tokens = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens, weights = tokens[order], got["w"].to_numpy(float)[order]
    if not len(tokens):
        return empty

    def clean_scores(batches):
        for rb in batches:
            texts, toxic = text_array(rb.column("text")), rb.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                w = words_of(texts[lo:hi])
                s = word_scores(w, tokens, weights)
                clean = np.repeat(toxic[lo:hi] == 0, np.diff(w.first))
                grid, n = np.unique(np.round(s[clean], 2), return_counts=True)
                segments = sum(len(maximal_segments(np.flatnonzero(x), x[x > 0], drift)) for x in
                               (s[w.first[r]:w.first[r + 1]] for r in range(hi - lo) if toxic[lo + r] == 0))
                yield batch(["s", "n", "segments"], [np.append(grid, -1.0), np.append(n, 0), np.append(n * 0, segments)],
                            [pa.float64(), pa.int64(), pa.int64()])

    law = (sample.mapInArrow(clean_scores, "s double, n long, segments long").groupBy("s")
           .agg(F.sum("n").alias("n"), F.sum("segments").alias("m")).toPandas())
    words, segments = float(law["n"].sum()), float(law["m"].sum())
    hits = law[law["s"] > 0]
    # half a word more at the mean weight: a score that no clean text showed is rare, not impossible
    scores = np.append(hits["s"].to_numpy(), weights.mean())
    rates = np.append(hits["n"].to_numpy(), 0.5) / max(words, 1.0)
    scale = _positive_root(scores, rates, drift)
    least = float(np.sum(rates * np.exp(-scale * scores)) / rates.sum())
    k = min(1.0, (segments + 0.5) / (max(words, 1.0) * least))
    return ToxicModel(tokens, weights, scale, k, n1 / (n0 + n1))


def _positive_root(scores: np.ndarray, rates: np.ndarray, drift: float) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1, by bisection; the expectation is convex in lambda."""
    rest = max(0.0, 1 - rates.sum())
    excess = lambda x: float(np.sum(rates * np.exp(np.minimum(x * scores, 700.0))) + rest * math.exp(-x * drift) - 1)
    lo, hi = 0.0, 1e-3
    while excess(hi) < 0:
        lo, hi = hi, 2 * hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if excess(mid) >= 0 else (mid, hi)
    return hi


def evidence(gains: list[float]) -> float:
    """Natural log of the Bayes factor that the segments of a text give, from their lambda S - ln K n."""
    best, total = 0.0, 0.0
    for r, gain in enumerate(sorted(gains, reverse=True), 1):
        total += gain
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best - 1 - math.log(best) if best > 1 else 0.0


def _passages(model: ToxicModel, drift: float):
    def run(batches):
        for rb in batches:
            texts, ids = text_array(rb.column("text")), rb.column("doc_id")
            for lo, hi in slices(texts):
                w = words_of(texts[lo:hi])
                s = word_scores(w, model.tokens, model.weights)
                found, score = [], []
                for r in range(hi - lo):
                    x = s[w.first[r]:w.first[r + 1]]
                    at = np.flatnonzero(x)
                    kept, gains = [], []
                    for a, b, total in maximal_segments(at, x[at], drift):
                        gain = model.scale * total - math.log(max(model.k * len(x), 1e-9))
                        if gain > 0:
                            kept.append({"start": a, "end": b, "score": total, "expected": math.exp(-gain)})
                            gains.append(gain)
                    odds = math.log(max(model.prior, 1e-9) / max(1 - model.prior, 1e-9)) + min(evidence(gains), 500.0)
                    found.append(kept)
                    score.append(1 / (1 + math.exp(-odds)))
                item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
                yield batch(["doc_id", "score", "passages"], [ids[lo:hi], score, pa.array(found, pa.list_(item))],
                            [pa.int64(), pa.float64(), pa.list_(item)])
    return run


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id",
                   text_col: str = "text", drift: float = DRIFT) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, passages.

    ``passages`` are the significant segments as word ranges (end exclusive) with their score and the number expected by chance.
    A text without one, a null or an empty text gets the share of toxic labels as its score. Rows that repeat a doc_id
    are scored each; an empty table gives no rows; other columns are not read.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(_passages(model, drift),
                          "doc_id long, score double, passages array<struct<start:long,end:long,score:double,expected:double>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
