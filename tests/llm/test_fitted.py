"""Language model, toxicity, tokenizers and packing against brute force."""

import base64
import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import brown_lm, byte_bpe, lp_packing, toxic_segments, word_ids
from tallyfield.llm.common import fold

SCHEMA = "doc_id long, text string, word string, n int, length double"
ODD = ["", None, " ", "a  b\n\n c", "it's 'Tis DON'T we'll", "x" * 700, "\n\n\n", "tab\there \x1c odd", "<|endoftext|> <|StartOfText|>",
       "École É 中文 😀 ß İ Σας", "one, two. three,, four.. 1,000 e.g.,", "  lead and trail  ", "same text", "same text"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, 0.5) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n=150):
    rng, out = random.Random(seed), []
    for _ in range(n):
        pool = [f"{rng.choice('ab')}{i}" for i in range(30)] if rng.random() < 0.5 else [f"c{i}" for i in range(40)]
        out.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(60))))
    return out


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def test_brown_counts_base_and_normalisation(spark):
    texts = [*prose(1), *[t for t in ODD if "\x1c" not in (t or "")]]
    got = {r.doc_id: r for r in brown_lm.score_documents(docs_of(spark, texts), fold("doc_id", 7) == 2, passes=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    c = collections.Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens), n)
        assert r.n_known == sum(c[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-6)
    test = [i for i in got if held[i]]
    assert sum(got[i].score for i in test) > sum(got[i].base_score for i in test)


def test_brown_probabilities_sum_to_one(spark):
    """Over all words, the unseen one of each class and the end, from any state."""
    pairs = np.random.default_rng(1).integers(0, 9, (brown_lm.CLASSES, brown_lm.CLASSES)).astype(float)
    pairs[3] = 0
    assert np.allclose((10 ** brown_lm.transitions(pairs)).sum(1), 1)


def test_exchange_raises_likelihood_and_splits_two_languages():
    rng = np.random.default_rng(3)
    units = 1 + 40
    text = np.concatenate([np.append(rng.integers(1, 21, 30) + 20 * (k % 2), 0) for k in range(300)])

    def table(classes):
        c = classes[text]
        out = np.zeros((units, 2 * brown_lm.CLASSES), np.int64)
        np.add.at(out, (text, np.concatenate([c[-1:], c[:-1]])), 1)
        np.add.at(out, (text[:-1], brown_lm.CLASSES + c[1:]), 1)
        return out

    classes = np.concatenate([[0], 1 + np.arange(40) % 4])
    values = []
    for _ in range(5):
        values.append(brown_lm.likelihood(brown_lm.class_pairs(table(classes), classes)))
        classes = brown_lm.exchange(table(classes), classes)
    assert values[-1] > values[0]


def test_brown_of_little(spark):
    assert brown_lm.score_documents(docs_of(spark, []), F.lit(False)).count() == 0
    rows = [(None, None, None, None, None), (5, "a b", "x", 1, 1.0), (5, "a b", "x", 1, 1.0), (5, "c", "x", 1, 1.0)]
    got = brown_lm.score_documents(spark.createDataFrame(rows, SCHEMA), F.lit(True), passes=1).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in got) == [
        ("5", 2, 0, 0), ("5", 3, 0, 0), ("5", 3, 0, 0), ("None", 1, 0, 0)]


def kadane(scores):
    best = now = 0.0
    for s in scores:
        now = max(0.0, now + s)
        best = max(best, now)
    return best


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 80)
        at = sorted(rng.sample(range(n), rng.randrange(min(n, 12) + 1)))
        score = [rng.choice([0.03, 0.5, 1.0, 3.0]) for _ in at]
        whole = [-0.05] * n
        for i, s in zip(at, score, strict=True):
            whole[i] = s
        found = toxic_segments.maximal_segments(np.array(at, int), np.array(score), 0.05)
        assert max([s for *_, s in found], default=0.0) == pytest.approx(kadane(whole))
        ends = 0
        for a, b, s in found:
            assert a >= ends and s == pytest.approx(sum(whole[a:b]))
            ends = b
            assert min(np.cumsum(whole[a:b])) > 0 and min(np.cumsum(whole[a:b][::-1])) > 0


def toxic_docs(seed, n=600):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["fool", "fools", "rotten", "rottenness"]))
        rows.append(" ".join(text))
        labels.append((i, 1 if bad else 0))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = toxic_docs(4)
    docs = docs_of(spark, [*texts, "", None, "rotten " * 5000])
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxic_segments.fit(docs, table.where(fold("doc_id", 3) != 1))
    got = {r.doc_id: r for r in toxic_segments.score_toxicity(docs, model).collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == y for i, y in test)
    assert right >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[len(texts)].score == got[len(texts) + 1].score == pytest.approx(model.prior)
    assert got[len(texts) + 2].predicted == 1
    for r in got.values():
        for p in r.passages:
            assert "fool" in texts_at(texts, r, p) or "rotten" in texts_at(texts, r, p)


def texts_at(texts, r, p):
    return " ".join(words(texts[r.doc_id] if r.doc_id < len(texts) else "rotten")[p.start:p.end] or ["rotten"])


def test_toxicity_without_labels(spark):
    model = toxic_segments.fit(docs_of(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxic_segments.score_toxicity(docs_of(spark, ["a b", None]), model).collect()] == [0, 0]
    assert toxic_segments.score_toxicity(docs_of(spark, []), model).count() == 0


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(7)
    alphabet = " \n\t\x1c ab'sS1.é,😀中ßA\r"
    texts = [*ODD, *["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(500)], "é" * 3000, " " * 2000 + "x"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    digests = {r.doc_id: r for r in byte_bpe.encoded_digests(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert (bytes(got[i].ids), bytes(got[i].decoded)) == (ids, (t or "").encode())
        assert digests[i].n_tokens == len(ids) // 4 and digests[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe_cache_overflow_changes_nothing(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    v = byte_bpe.Vocabulary(path, public_tokenizers.PATTERN)
    for _ in range(2):
        for t in ODD:
            assert v.decode(v.encode([t or ""])[0]) == (t or "").encode()


def test_word_ids_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\tab'sS1.é,A") for _ in range(rng.randrange(50))) for _ in range(300)]
    for size in (600_000, 4):
        monkeypatch.setattr(word_ids, "CACHE", size)
        got = word_ids.encode(texts, path)
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_cost_less_than_a_translated_text():
    text = "Él Niño\tzum\nÄußerer Wert\r" * 40_000

    def seconds(run):
        def once():
            start = time.process_time()
            run()
            return time.process_time() - start
        return min(once() for _ in range(5))

    blanks = str.maketrans("\t\n\r", "   ")
    assert word_ids.pieces_of(text)[:5] == ["Él", "niño", "zum", "Äußerer", "wert"]
    assert word_ids.pieces_of("<|A\tB") == ["<|A", "B"]
    assert seconds(lambda: word_ids.pieces_of(text)) < seconds(lambda: text.translate(blanks))


def test_packing_is_gapless_and_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(lp_packing, "RANKED", 50)
    rng = random.Random(9)
    rows = [(i, 0, 0, min(64, 1 + int(rng.expovariate(0.05))), i) for i in range(1500)] + [(i, 1, 64, 64, 1) for i in range(500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = lp_packing.pack(pieces, 64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(rows)
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.02 * -(-sum(r[3] for r in rows) // 64) + 2


def test_configurations_respect_demand():
    lengths, demand = np.array([1, 3, 5, 8, 13, 20]), np.array([7, 100, 40, 1, 33, 12])
    used = lp_packing.solve_configurations(lengths, demand, 20)
    total = sum((c * t for c, t in used), np.zeros(6, int))
    assert (total <= demand).all() and all(c @ lengths <= 20 and t > 0 for c, t in used)
    rest = lp_packing.best_fit(lengths, demand - total, 20)
    assert (total + sum((c * t for c, t in rest), np.zeros(6, int)) == demand).all()


def test_packed_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "word " * 150]
    got = lp_packing.pack_documents(docs_of(spark, texts), path, capacity=64).collect()
    for i, t in enumerate(texts):
        ids = word_ids.encode([t or ""], path)[0] + b"\0\0\0\0"
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [
            (k, a, len(ids[4 * a:4 * a + 256]) // 4, zlib.crc32(ids[4 * a:4 * a + 256])) for k, a in enumerate(range(0, len(ids) // 4, 64))]
    assert lp_packing.pack_documents(docs_of(spark, []), path).count() == 0
