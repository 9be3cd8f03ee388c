"""MinHash near-duplicates with sequential Bayesian verification.

Banded MinHash keys give candidates. A candidate pair's signatures are then compared in batches: after n
compared hashes with m equal ones, similarity has the posterior Beta(m + 1, n - m + 1) under a uniform prior, and
the pair is dropped once the posterior probability of reaching the threshold is below ``miss``. Survivors are
verified on their whole shingle sets.

Documents with equal shingle sets are one node from the start, so copies cost one row each and never meet in
pairs. Nodes are named by a 64-bit hash of the sorted set.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, rewritten, row_key, slices, text_array, texts_of
from tallyfield.llm.links import linked_components, ties_of
from tallyfield.llm.words import mix, shingle_hashes, words_of

BANDS, ROWS = 40, 6
STEP = 40


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    return ((x[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)), (x[1::2] >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS 32-bit multiply-add hashes of the mixed shingle hashes."""
    a, b = _coefficients()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        part = x[None, lo:lo + 4096]
        for k in range(0, len(a), 24):
            out[k:k + 24] = np.minimum(out[k:k + 24], (part * a[k:k + 24, None] + b[k:k + 24, None]).min(1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def set_name(shingles: np.ndarray) -> int:
    """64-bit name of a sorted set."""
    place = mix(np.arange(1, len(shingles) + 1, dtype=np.uint64))
    return int(mix(np.array([np.sum(mix(shingles) * (place | np.uint64(1)), dtype=np.uint64)])
                   + np.uint64(len(shingles))).view(np.int64)[0])


@lru_cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest equal hashes with posterior P(similarity >= t) at least ``miss``.

    P = sum over j <= m of C(n + 1, j) t^j (1 - t)^(n + 1 - j), the Beta tail as a binomial sum.
    """
    t, out = percent / 100, []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = m = 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        out.append(m)
    return tuple(out)


def plausible(sig: np.ndarray, i: int, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Those of ``others`` that no batch ruled out, most similar first."""
    equal = np.zeros(len(others), np.int32)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        equal += (sig[others, part] == sig[i, part]).sum(1)
        keep = equal >= need
        others, equal = others[keep], equal[keep]
    return others[np.argsort(-equal, kind="stable")]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _features(k: int):
    def run(batches):
        for rb in batches:
            texts, ids = text_array(rb.column("text")), rb.column("doc_id")
            for lo, hi in slices(texts):
                w = words_of(texts[lo:hi])
                n, node, keys = [], [], []
                for r in range(hi - lo):
                    s = np.unique(shingle_hashes(w.hashes[w.first[r]:w.first[r + 1]], k))
                    n.append(len(s))
                    node.append(set_name(s) if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else [])
                yield batch(["doc_id", "key", "n_shingles", "node", "keys"], [ids[lo:hi], rb.column("key")[lo:hi], n, node, keys],
                            [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())])
    return run


def _sets(k: int):
    def run(batches):
        for rb in batches:
            texts = text_array(rb.column("text"))
            nodes = rb.column("node").to_pylist()
            for lo, hi in slices(texts):
                w = words_of(texts[lo:hi])
                sets = [np.unique(shingle_hashes(w.hashes[w.first[r]:w.first[r + 1]], k)) for r in range(hi - lo)]
                keep = [r for r in range(hi - lo) if len(sets[r]) and set_name(sets[r]) == nodes[lo + r]]
                rows = pa.array([lo + r for r in keep], pa.int64())
                out = [rb.column(c).take(rows) for c in ("node", "q", "bin", "split")]
                sigs = [signature(sets[r]) for r in keep]
                keys = [band_keys(x) if split else [] for x, split in zip(sigs, out[3].to_pylist(), strict=True)]
                yield batch(["node", "q", "bin", "split", "keys", "sig", "shingles"],
                            [*out, keys, [x.tobytes() for x in sigs], [sets[r].tobytes() for r in keep]],
                            [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``near_duplicate_rows`` without its key.
    """
    return near_duplicate_rows(docs, id_col, text_col, words, percent, miss).drop("key")


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                        percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (``row_key``), n_shingles, component_id, kept.

    Two documents are linked when 100 * common >= percent * all of their distinct ``words``-word shingles;
    component_id is the smallest doc_id that links reach and kept tells whether it is the row's own. A text of
    fewer words is one shingle; a null, empty or blank text has none, is linked with nothing and kept. Rows that
    repeat a doc_id and text are all kept or all not; of linked rows that share a doc_id but not a text, one text is kept. A null doc_id is never a component's name unless it has no
    other, and such a row is kept only then. Other columns are not read.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", row_key())
    features = rewritten(rows.mapInArrow(_features(words), "doc_id long, key long, n_shingles long, node long, keys array<long>"))
    members = features.where("node is not null").select(F.explode("keys").alias("key"), "node")
    # the smallest id names a node, and of the texts under that id the smallest key; no id is the largest
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")
    names = features.where("node is not null").groupBy("node").agg(F.min(name).alias("name"))

    def payload(dealt: DataFrame) -> DataFrame:
        wanted = dealt.join(names, "node").select("node", "q", "bin", "split", F.col("name.key").alias("rep"))
        return (rows.join(wanted, F.col("key") == F.col("rep")).select("text", "node", "q", "bin", "split")
                .mapInArrow(_sets(words), "node long, q long, bin long, split int, keys array<long>, sig binary, shingles binary"))

    least = least_matches(percent, miss)

    def open_bin(table: pa.Table):
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(table.num_rows, BANDS * ROWS)
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        keys = np.stack([band_keys(s) for s in sig])

        def matcher(i, others):
            for j in plausible(sig, i, others, least):
                yield int(j), lambda j=j: similar(sets[i], sets[j], percent)

        return keys, matcher

    comps = linked_components(ties_of(members), payload, open_bin)
    named = comps.join(names, "node")
    smallest = named.groupBy("root").agg(F.min("name").alias("component"))
    of_node = named.join(smallest, "root").select("node", "component")
    alone = names.join(of_node, "node", "left").select("node", F.coalesce("component", "name").alias("component"))
    out = features.select("doc_id", "key", "n_shingles", "node").join(alone, "node", "left")
    lone = F.col("node").isNull()
    return out.select("doc_id", "key", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component.id")).alias("component_id"),
                      (lone | (F.col("key") == F.col("component.key"))).alias("kept"))
