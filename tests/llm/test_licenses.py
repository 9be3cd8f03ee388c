"""Licence scan against a plain search for phrases."""

import random
import re

import pytest

from tallyfield.llm import license_index

SCHEMA = "doc_id long, text string, w string, votes int, t double"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_row(text):
    w, at, labels = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(2)
    pool = "gnu general public license apache cc by mit the of é software K kit version 2 3 nc free".split()
    out = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(120)]
    out += [None, "", " \n\t", "...", "MIT  LICENSE", "mit license", "Apache-License; apache_license", "CC-BY-NC 4.0 and cc by",
            "the Kit mitİ license", "x " * 200_000 + "mit license " * 3, "mitlicense", "license mit license", "public license"]
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, t, "w", 1, 0.5) for i, t in enumerate(texts())]
    return {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_base_phrases_equal_a_plain_search(scanned):
    for i, t in enumerate(texts()):
        r = scanned[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_row(t), t
        assert 0 <= r.score <= 1 and (r.score == 1) == (r.n_base > 0 or any(m.share == 1 for m in r.matches))


def test_notices_are_found_where_they_stand(spark):
    notice = {t.label: t for t in license_index.NOTICES}
    filler = "plain words that say nothing of the sort "
    rows = [(k, filler * (k + 1) + t.text.upper() + " " + filler) for k, t in enumerate(notice.values())]
    torn = notice["mit-text"].text.split()
    rows += [(100, " ".join(torn[:8] + ["oops"] + torn[9:])), (101, " ".join(torn[:4])), (102, " ".join(reversed(torn)))]
    docs = spark.createDataFrame([(i, t, "w", 1, 0.5) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in license_index.scan(docs).collect()}
    for k, label in enumerate(notice):
        hit = [m for m in got[k].matches if m.label == label]
        assert [(m.start, round(m.share, 9)) for m in hit] == [((k + 1) * 8, 1.0)] and label in got[k].labels.split(",")
    assert got[100].labels == "mit-text" and 0.5 < got[100].score < 1
    assert got[101].labels == got[102].labels == "" and got[101].score == got[102].score == 0


def test_repeated_rows_and_none(spark):
    rows = [(None, "mit license", None, None, None)] * 2 + [(3, None, None, None, None)]
    got = license_index.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in got) == [("3", 0, ""), ("None", 1, "mit"), ("None", 1, "mit")]
    assert license_index.scan(spark.createDataFrame([], SCHEMA)).count() == 0
