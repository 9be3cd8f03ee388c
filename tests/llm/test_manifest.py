"""Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, h long, pos int, n int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, fan):
    """Levels of a tree from the leaves to the top."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings(levels, at, fan):
    out = []
    for level in levels[:-1]:
        lo = at // fan * fan
        out.append((level[lo:at], level[at + 1:lo + fan]))
        at //= fan
    return out


def brute(rows, fan):
    leaf = {i: sha(*map(field, r[:5])) for i, r in enumerate(rows)}
    forge = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1], []).append(i)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
    lower = {g: climb([leaf[i] for i in groups[g]], fan) for g in names}
    upper = climb([lower[g][-1][0] for g in names], fan)
    out = []
    for k, g in enumerate(names):
        for at, i in enumerate(groups[g]):
            path = siblings(lower[g], at, fan) + siblings(upper, k, fan)
            r = list(rows[i][:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                r[4] = forge(r[4])
            h = sha(*map(field, r))
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r[0], leaf[i], lower[g][-1][0], upper[-1][0], sha(*[x for a, b in path for x in a + b]), h, h == upper[-1][0]))
    return out


def table_rows():
    rows = []
    for i in range(150):  # a hot source
        rows.append((i * 3, "hot", "en", i, f"Text Number {i}" if i % 4 else None))
    rows += [(i, f"s{i % 23}", None, None, "É Upper" * i) for i in range(60)]
    rows += [(7, "alone", "en", 1, ""), (None, None, None, None, None), (None, None, "x", None, "A"), (5, "", "x", 2, "Z" * 200_000),
             (9, "hot", "en", 1, "other"), (9, "hot", "en", 1, "other"), (-30, "s1", "en", 1, "N")]
    return [(*r, "g", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("fan,levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, fan, levels):
    monkeypatch.setattr(merkle_manifest, "FAN", fan)
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    rows = table_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle_manifest.manifest(docs, marked)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    want = brute(rows, fan)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(3, "s", None, 4, "Abc", "", 0, 0, 0)], SCHEMA)
    row = merkle_manifest.manifest(one, F.lit(True)).first()
    assert row.leaf == row.subroot == row.root == sha("1:3", "1:s", "-", "1:4", "3:Abc") and row.proof_sha256 == sha()
    assert row.folded_root == sha("1:3", "1:s", "-", "1:4", "3:abc") and not row.verified
    assert merkle_manifest.manifest(one.limit(0), F.lit(True)).count() == 0
