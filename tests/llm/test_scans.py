"""Media chunks, personal data, secrets and exact dedup on hand-made tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import crf_pii, exact_dedup, media_chunks, secret_forest

SCHEMA = "doc_id long, text string, source string, h string, n string, candidate string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "src", "h", "n", "c") for i, t in enumerate(texts)], SCHEMA)


def test_gear_hashes_roll():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(media_chunks._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media_chunks.gear_hashes(data).tolist() == want


def test_chunks_follow_content():
    rng = random.Random(2)
    shared = rng.randbytes(40_000)
    a, b = media_chunks.chunked([shared, rng.randbytes(777) + shared])
    assert b"".join(a) == shared
    assert len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c) <= media_chunks.MOST for c in a) and all(len(c) >= media_chunks.LEAST for c in a[:-1])


@pytest.mark.parametrize("bitmap", [26, 15])
def test_media_round_trip(spark, monkeypatch, bitmap):
    monkeypatch.setattr(media_chunks, "BITMAP", bitmap)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(4000))
    passage = " ".join(word() for _ in range(900))
    texts = ["", None, "x", "x" * 192, "y" * 191 + "é", long, long, *[passage] * 5, "ab " * 30 + passage, passage + long, long + passage]
    got = {r.doc_id: r for r in media_chunks.store_and_read(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        chunks = media_chunks.chunked([payload])[0]
        form = media_chunks.stored_form(chunks)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest())
        assert r.feature == media_chunks.features(payload, len(chunks))
    assert media_chunks.store_and_read(docs_of(spark, [])).count() == 0


def test_damaged_store_is_noticed(spark):
    from tallyfield.session import scratch_path

    path = scratch_path(spark, "damaged")
    media_chunks.write_store(docs_of(spark, ["a text", "another"]), path)
    own = spark.read.parquet(f"{path}/own").withColumn("chunks", F.transform("chunks", lambda c: F.concat(c, F.lit(b"!")))).collect()
    other = scratch_path(spark, "damaged")
    spark.createDataFrame(own, spark.read.parquet(f"{path}/own").schema).write.parquet(f"{other}/own")
    for part in ("recipes", "shared"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="do not give payload"):
        media_chunks.read_store(spark, other).collect()


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum((x * 2 - 9 * (x > 4) if k % 2 else x) for k, x in enumerate(map(int, d[::-1])))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PII = ["write to a.b@c-d.example.com, or x@y", "host 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111111111111112",
       "call +1 (489) 555-8583 now", "café 😀 bob@mail.example.org +44 20 7946 0958 10.9.8.7", "@@ a@b.c@d.e +1+1 +49", "", None, "none here",
       "a@ b.c", "　é@x.y", "٣@a.b 12", "5" * 4000, "1 " * 3000]


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    noise = ["".join(rng.choice("a@.+-() 0123456789\n") for _ in range(60)) for _ in range(3000)]
    for t in [x or "" for x in PII] + noise:
        assert crf_pii.base_spans(t) == plain_base(t), t


def brute_best(model, w):
    """Best score over all segmentations."""
    s = model.scores(w)
    best = {(0, crf_pii.OUTSIDE): 0.0}
    for j in range(1, w.n + 1):
        for k in w.ending[j]:
            for (i, before), value in list(best.items()):
                if i == w.places[k][0]:
                    for c in range(crf_pii.OUTSIDE + 1):
                        best[j, c] = max(best.get((j, c), -np.inf), value + model.moves[before, c] + s[k, c])
    return max(v for (j, _), v in best.items() if j == w.n)


def test_crf_gradient_decoding_and_learning():
    rng = np.random.default_rng(1)
    model = crf_pii.SemiCrf(rng.normal(size=(crf_pii.OUTSIDE + 1, crf_pii.WIDTH)), rng.normal(size=(5, 5)))
    text = "call me +1 (489) 555-8583 or 10.0.0.1 4111 1111 1111 1111 ok"
    (w, gold), = crf_pii.examples(text, crf_pii.base_spans(text))
    value, g, m = model.gradient(w, gold)
    for table, grad in ((model.weights, g), (model.moves, m)):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in table.shape)
            old = table[at]
            table[at] = old + 1e-5
            up = model.gradient(w, gold)[0]
            table[at] = old - 1e-5
            down = model.gradient(w, gold)[0]
            table[at] = old
            assert (up - down) / 2e-5 == pytest.approx(grad[at], abs=1e-4)
    assert np.isfinite(value) and value < 0
    spans = model.decode(w)
    s, total, before = model.scores(w), 0.0, crf_pii.OUTSIDE
    for k, c in crf_pii.gold_of(w, spans):
        total += s[k, c] + model.moves[before, c]
        before = c
    assert total == pytest.approx(brute_best(model, w))


def test_find_pii(spark):
    rng = random.Random(8)
    train = [f"word word {rng.choice(['call', 'tel', 'at'])} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} more and "
             f"mail a{i}@mail{i % 9}.example.com then {rng.randrange(1, 250)}.4.5.{i % 250} and version {i} of it" for i in range(80)]
    model = crf_pii.fit(docs_of(spark, train))
    texts = [*PII, "tel 1 489 555-8583 today"]
    got = {r.doc_id: r for r in crf_pii.find_pii(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for _, x, _ in base) for k in range(4))
        assert got[i].base_sha256 == hashlib.sha256(crf_pii.named(base).encode()).hexdigest()
        assert set(crf_pii.named(base).split(",")) - {""} <= set(got[i].spans.split(","))
    assert "phone:4:18" in got[len(texts) - 1].spans
    assert crf_pii.find_pii(docs_of(spark, []), model).count() == 0
    untrained = crf_pii.fit(docs_of(spark, []))
    assert crf_pii.find_pii(docs_of(spark, ["10.0.0.1 x 1 489 555-8583"]), untrained).first().spans == "ip:0:8"


SPELLED = ["jane.doe at example dot com", "jane at example.org", "jane_doe [at] mail [dot] example [dot] org", "bob (at) example (dot) net",
           "jane dot doe at mail dot example dot com"]


def test_spelled_out_addresses_without_digits(spark):
    rng = random.Random(3)
    names = ["ann", "bert", "carla.x", "dora", "emil.jones"]
    train = [f"please write to {rng.choice(names)}@mail.{rng.choice(['example.com', 'test.org'])} when version {i} is at home again" for i in range(90)]
    model = crf_pii.fit(docs_of(spark, train))
    around = ["please write to {} today or", "call +1 489 555 8583 or mail {} by then", "(mail: {}), thanks"]
    texts = [a.format(s) for s in SPELLED for a in around] + ["we looked at home. dot com was at noon", "at dot at", "at"]
    got = {r.doc_id: r for r in crf_pii.find_pii(docs_of(spark, texts), model).collect()}
    for i, (s, a) in enumerate([(s, a) for s in SPELLED for a in around]):
        at = a.index("{")
        assert f"email:{at}:{at + len(s)}" in got[i].spans.split(","), texts[i]
    assert [got[i].spans for i in range(len(texts) - 3, len(texts))] == [""] * 3


def secret_texts():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
    prose = lambda: " ".join(rng.choice(["the", "and", "thing", "other", "station", "shed", "internationalisation"]) for _ in range(15))
    texts, truth = [], []
    for i in range(120):
        kind = i % 4
        secret = {0: hexes(40), 1: key(), 2: hexes(20)}.get(kind)
        shown = {0: f'token = "{secret}"', 1: secret, 2: f"password={secret}"}.get(kind, "counterrevolutionaries 4111111111111111")
        texts.append(f"{prose()} {shown} {prose()}")
        truth.append(secret)
    return texts, truth


def test_secrets_are_found_and_masked(spark):
    texts, truth = secret_texts()
    more = ["", None, "short", "password=" + "f0" * 10 + " and password=" + "f0" * 10, "z" * 50_000]
    docs = docs_of(spark, texts + more)
    got = secret_forest.scan(docs).collect()
    for r in got:
        t = (texts + more)[r.doc_id]
        cut = t[r.start:r.start + r.size]
        assert re.fullmatch(secret_forest.CANDIDATE, cut)
        if r.doc_id < len(texts):
            assert r.is_secret == (cut == truth[r.doc_id])
    assert {r.doc_id for r in got if r.is_secret} >= {i for i, s in enumerate(truth) if s}
    out = {r.doc_id: r.text for r in secret_forest.redact(docs).collect()}
    for i, (t, s) in enumerate(zip(texts, truth, strict=True)):
        assert out[i] == (t.replace(s, secret_forest.MASK) if s else t)
    assert out[len(texts)] == "" and out[len(texts) + 1] is None and out[len(texts) + 4] == more[4]
    assert out[len(texts) + 3] == "password=[SECRET] and password=[SECRET]"


def test_secrets_without_labels_or_rows(spark):
    assert secret_forest.scan(docs_of(spark, [])).count() == 0
    assert secret_forest.redact(docs_of(spark, [None, ""])).count() == 2
    rows = [(None, "key abcdefabcdef0123456789", None, "h", "n", "c")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = secret_forest.scan(docs).collect()
    assert [(r.doc_id, r.part, r.start, r.is_secret) for r in got] == [(None, 0, 4, True)]
    out = secret_forest.redact(docs)
    assert out.columns == docs.columns and [r.text for r in out.collect()] == ["key [SECRET]"] * 2


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, weak, keep):
    texts = ["a", "A", "a", "", None, "b" * 100_000, "b" * 100_000, "a ", "é", "é", *["hot"] * 40]
    rows = [(i, t, "s", "h", "n", "c") for i, t in enumerate(texts)] + [(None, "a", None, None, None, None), (8, "é", "s", "h", "n", "c")]
    hash_of = (lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)) if weak else exact_dedup.content_hash
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), keep=keep, hash_of=hash_of).collect()
    want = []
    for i, t, *_ in rows:
        same = [x for x, y, *_ in rows if (y or "") == (t or "")]
        kept = (min if keep == "min" else max)(x for x in same if x is not None)
        want.append((i, kept, len(same), i == kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)
