"""Grouping, near-duplicates and fuzzy lines against brute force."""

import random

import numpy as np
import pytest

from tallyfield.llm import fuzzy_lines, links, minhash_dedup

SCHEMA = "doc_id long, text string, node string, key int, root double"


def components(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(seed, docs=60, words=40):
    rng, out = random.Random(seed), []
    for _ in range(docs):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(words)] = f"x{rng.randrange(400)}"
            out.append(" ".join(copy))
        out.append(" ".join(base))
    return out


def brute_sets(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("width,binned", [(2, 1024), (5, 1024), (2, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, binned):
    monkeypatch.setattr(links, "BIN", binned)
    texts = near_copies(3) + ["", None, "  \n", "One", "one", "two words", "Two Words", "a a a a a a a"] + ["copy of this text"] * 30
    rows = [(i, t, "x", 1, 0.5) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=width).collect()}
    sets = [brute_sets(t, width) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i)
              if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), linked)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_near_duplicates_empty_null_and_repeated(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e f", None, None, None), (7, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None),
            (None, "quite another text", None, None, None), (9, "a " * 30_000, None, None, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("9", "9", True), ("None", "7", False), ("None", "None", True)]


def test_posterior_bounds_never_drop_what_the_batches_support():
    for need, n in zip(minhash_dedup.least_matches(80, 1e-6), range(40, 241, 40), strict=True):
        assert need < 0.8 * n
    assert minhash_dedup.least_matches(80, 1e-3) > minhash_dedup.least_matches(80, 1e-9)


@pytest.mark.parametrize("chunk", [500_000, 7])
def test_components_of_a_long_chain(spark, monkeypatch, chunk):
    monkeypatch.setattr(links, "EDGES", chunk)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    got = {r.node: r.root for r in links.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        assert fuzzy_lines.edit_distance(a, b) == levenshtein(a, b)


def normal(line):
    out = []
    for c in line.encode():
        c = c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        out.append(c if c >= 128 or 97 <= c <= 122 or c == 48 else 32)
    return b" ".join(bytes(out).split())


def line_texts(seed):
    rng = random.Random(seed)
    base = [" ".join(f"word{rng.randrange(9)}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(25)) for _ in range(12)]
    docs = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["z", "", "!", "Q"]) + line[at + 1:]
            lines.append(line if rng.random() < 0.9 else rng.choice(["", "  ", "...", "Ab cd.", "ab CD"]))
        docs.append("\n".join(lines))
    return [*docs, "", None, "\n\n", "é ö\nÉ Ö", "x" * 300 + " y", " ".join(["one"] * 700)]


@pytest.mark.parametrize("binned", [1024, 4])
def test_line_groups_equal_brute_force(spark, monkeypatch, binned):
    monkeypatch.setattr(links, "BIN", binned)
    texts = line_texts(1)
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in enumerate(texts)], SCHEMA)
    places = [(i, k, normal(x)) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if normal(x)]
    kinds = sorted({p[2] for p in places})
    # all pairs by edit similarity alone: one edit in such lines never meets all blocks
    linked = [(i, j) for i in range(len(kinds)) for j in range(i)
              if levenshtein(kinds[i], kinds[j]) <= max(len(kinds[i]), len(kinds[j])) * 10 // 100]
    of = components(range(len(kinds)), linked)
    first = {}
    for i, k, x in places:
        first[of[kinds.index(x)]] = min(first.get(of[kinds.index(x)], (i, k)), (i, k))
    want = {(i, k): (*first[of[kinds.index(x)]], first[of[kinds.index(x)]] == (i, k)) for i, k, x in places}
    got = fuzzy_lines.line_groups(docs).collect()
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line, r.kept) for r in got} == want
    assert any(len(x) > 1 for x in [[j for j in of if of[j] == r] for r in set(of.values())])
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, {})[r.line] = r.kept
    out = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        if i not in kept:
            assert out[i] == t
        elif not any(kept[i].values()):
            assert i not in out
        else:
            assert out[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if kept[i].get(k, True))


EVERY = np.ones(1 << 16, bool)


def flat_forms(lines):
    tail = np.cumsum([len(x) + 2 for x in lines])
    return np.frombuffer(b"".join(b" " + x + b" " for x in lines), np.uint8), np.append(0, tail[:-1]), tail


def test_simhash_is_the_majority_of_the_pieces_bits():
    rng = random.Random(3)
    lines = [bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(2, 200))) for _ in range(150)] + [b"ab" * 20_000]
    got = fuzzy_lines.simhashes(*flat_forms(lines), EVERY)
    for i, x in enumerate(lines):
        y = b" " + x + b" "
        pieces = np.array([int.from_bytes(y[k:k + 4], "little") for k in range(len(y) - 3)], np.uint64)
        for k, odd in enumerate(fuzzy_lines._ODDS):
            bits = np.unpackbits(fuzzy_lines.mix(pieces ^ odd).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
            assert got[i, k] == np.packbits(bits > len(pieces) // 2, bitorder="little").view(np.uint64)[0]


def test_lines_that_allow_one_edit_always_share_a_key():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randrange(10, 20)
        base = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        at = rng.randrange(n)
        copy = rng.choice([base[:at] + b"z" + base[at + 1:], base[:at] + base[at + 1:], base[:at] + b"z" + base[at:]])
        if max(len(base), len(copy)) > 19 or max(len(base), len(copy)) < 10:
            continue
        keys, far, near = fuzzy_lines.line_keys(*flat_forms([base, copy]), 14, 90, EVERY)
        same = np.flatnonzero((keys[0] == keys[1]) & (keys[0] >= 0))
        halves = same[same >= 2 * fuzzy_lines.BLOCKS]
        assert len(halves), (base, copy)
        apart = [bin(int(far[0, c] ^ far[1, c])).count("1") + bin(int(near[0, c] ^ near[1, c])).count("1") for c in halves]
        assert min(apart) <= fuzzy_lines.CLOSE_PAIRS


@pytest.mark.parametrize("run", [8192, 3])
def test_ties_of_a_key_join_what_is_close(monkeypatch, run):
    import pyarrow as pa

    monkeypatch.setattr(fuzzy_lines, "RUN", run)
    monkeypatch.setattr(fuzzy_lines, "STEPS", 5)
    rng = random.Random(4)
    rows = sorted((rng.randrange(60) << 33 | rng.randrange(4), rng.randrange(2) * ((1 << 60) - 1), i) for i in range(70_000 if run > 3 else 400))
    rows += [((1 << 40) | 0, 0, 100_000 + i) for i in range(5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + 997]], pa.int64()) for c in range(3)], names=["key", "rest", "node"])
               for i in range(0, len(rows), 997)]
    ties = [(a, b) for rb in fuzzy_lines._ties(iter(batches)) for a, b in zip(rb.column("a").to_pylist(), rb.column("b").to_pylist(), strict=True)]
    got = components([r[2] for r in rows], ties)
    sizes = {}
    for k, *_ in rows:
        sizes[k >> 32] = sizes.get(k >> 32, 0) + 1
    # of a large key all, else those whose further bits agree (both values of the rest are far apart)
    name = {i: (k >> 32, None if sizes[k >> 32] > run else rest) for k, rest, i in rows}
    groups = {}
    for i, g in name.items():
        groups.setdefault(g, []).append(i)
    assert got == {i: min(m) for m in groups.values() for i in m}


def test_long_lines(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghij ") for _ in range(1_000_000))
    rows = [(1, word, "x", 1, 0.5), (2, word[:500_000] + "zz" + word[500_002:], "x", 1, 0.5), (3, "0" * 200_000, "x", 1, 0.5)]
    got = {r.doc_id: r.first_doc_id for r in fuzzy_lines.line_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_line_groups_of_nothing(spark):
    assert fuzzy_lines.line_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fuzzy_lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "same line here", "n", None, None), (None, "same line here", "n", None, None), (3, "Same line, here", "n", None, None)]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "node", "key", "root"]
    assert [r.doc_id for r in out.collect()] == [None, None]


def test_lines_of_90_percent_are_found_without_a_block_condition(spark):
    """All pairs by edit similarity alone: one or two words of 10, 25 and 60 changed, and single letters of short lines."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    lines = []
    for n, changed in [(10, 1), (25, 1), (25, 2), (60, 3), (4, 0), (1, 0)] * 15:
        base = [word() for _ in range(n)] if n > 1 else ["".join(word() for _ in range(5))]
        copy = list(base)
        for at in rng.sample(range(n), changed):
            copy[at] = "".join(rng.sample(copy[at], len(copy[at])))
        if not changed:
            text = " ".join(copy)
            at = rng.randrange(len(text))
            copy = [text[:at] + "q" + text[at + 1:]]
        lines += [" ".join(base), " ".join(copy)]
    normals = [normal(x) for x in lines]
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if fuzzy_lines.alike(normals[i], normals[j], 90)]
    want = components(range(len(lines)), linked)
    got = {r.doc_id: r.first_doc_id for r in fuzzy_lines.line_groups(
        spark.createDataFrame([(i, x, "x", 1, 0.5) for i, x in enumerate(lines)], SCHEMA)).collect()}
    found = sum(got[i] == got[j] for i, j in linked)
    assert len(linked) > 60 and found >= 0.95 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)


def scattered(rng, line, edits):
    out = bytearray(line)
    for at in sorted(rng.sample(range(len(line)), edits), reverse=True):
        kind = rng.randrange(3)
        out[at:at + 1] = [b"", bytes([out[at], 113]), b"q"][kind]
    return bytes(out)


def test_lines_with_ten_percent_scattered_edits_are_linked(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (20, 45, 90, 250, 700) for _ in range(6)]
    copies = []
    for x in base:
        edits = len(x) // 10
        copy = scattered(rng, x.encode(), edits).decode()
        while not fuzzy_lines.alike(x.encode(), copy.encode(), 90):
            edits -= 1
            copy = scattered(rng, x.encode(), edits).decode()
        copies.append(copy)
    docs = spark.createDataFrame([(i, x, "x", 1, 0.5) for i, x in enumerate(base + copies)], SCHEMA)
    got = {r.doc_id: r.first_doc_id for r in fuzzy_lines.line_groups(docs).collect()}
    assert got == {i: i % len(base) for i in range(2 * len(base))}


@pytest.mark.parametrize("probe,matches,percent", [(1 << 18, 1 << 20, 90), (64, 50, 90), (64, 50, 75)])
def test_edit_links_equal_brute_force(monkeypatch, probe, matches, percent):
    from tallyfield.llm import edit_links

    monkeypatch.setattr(edit_links, "PROBE", probe)
    monkeypatch.setattr(edit_links, "INDEX", probe)
    monkeypatch.setattr(edit_links, "MATCHES", matches)
    rng = random.Random(percent)
    lines = {b"x" * 400, b"x" * 380 + b"yyy"}
    for _ in range(25):
        base = bytes(rng.choice(b"abcde ") for _ in range(rng.choice([3, 9, 10, 12, 19, 20, 30, 50, 100, 250])))
        lines |= {base} | {scattered(rng, base, rng.randrange(len(base) * (100 - percent) // 100 + 2)) for _ in range(4)}
    lines = sorted(lines - {b""})
    rng.shuffle(lines)
    n = range(len(lines))
    want = components(n, [(i, j) for i in n for j in range(i) if fuzzy_lines.alike(lines[i], lines[j], percent)])
    got = edit_links.links_of(lines, np.full(len(lines), 3), percent, lambda i, j: fuzzy_lines.alike(lines[i], lines[j], percent))
    assert components(n, got) == want and len(set(want.values())) < len(lines)


def test_blocks_of_a_class_meet_each_other(spark, monkeypatch):
    from tallyfield.llm import edit_links

    monkeypatch.setattr(edit_links, "BLOCK", 300)
    rng = random.Random(2)
    base = [bytes(rng.choice(b"abcdefgh") for _ in range(n)) for n in range(9, 130, 2)]
    lines = sorted({y for x in base for y in (x, scattered(rng, x, max(1, len(x) // 12)), scattered(rng, x, 1))})
    n = range(len(lines))
    want = components(n, [(i, j) for i in n for j in range(i) if fuzzy_lines.alike(lines[i], lines[j], 90)])
    nodes = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)], "node long, normal binary")
    sizes = spark.createDataFrame([(len(x),) for x in lines], "size int")
    got = {r.node: r.root for r in edit_links.linked_lines(nodes, sizes, 90, fuzzy_lines.alike).collect()}
    assert {i: got.get(i, i) for i in n} == want
    assert edit_links.linked_lines(nodes.where("node < 0"), sizes.where("size < 0"), 90, fuzzy_lines.alike).count() == 0


def test_lines_are_dealt_as_compressed_packs(spark, monkeypatch):
    """Each line once a pack, in less than its bytes; repeats in other packs change nothing."""
    import pyarrow as pa

    from tallyfield.llm import edit_links

    rng = random.Random(4)
    base = [" ".join(rng.choice(["apple", "brick", "cloud", "drift", "ember", "frost"]) for _ in range(40)).encode() for _ in range(30)]
    lines = sorted({y for x in base for y in (x, scattered(rng, x, 4))})
    size = sum(len(x) for x in lines)
    made = pa.RecordBatch.from_pydict({"node": list(range(len(lines))) * 3, "normal": pa.array(lines * 3, pa.binary())})
    blocks = {int(c): 1 for c in edit_links._classes(np.array([len(x) for x in lines]), 90)}
    packs = pa.Table.from_batches(list(edit_links._packs(iter([made, made.slice(0, 0)]), 90, blocks))).to_pylist()
    assert sum(p["n"] for p in packs if not p["up"]) == len(lines)
    assert sum(len(p["lines"]) for p in packs if not p["up"]) < 0.7 * size
    monkeypatch.setattr(edit_links, "PACK", 2000)
    monkeypatch.setattr(edit_links, "BLOCK", size // 5)
    n = range(len(lines))
    want = components(n, [(i, j) for i in n for j in range(i) if fuzzy_lines.alike(lines[i], lines[j], 90)])
    nodes = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)] * 3, "node long, normal binary").repartition(5)
    sizes = spark.createDataFrame([(len(x),) for x in lines], "size int")
    got = {r.node: r.root for r in edit_links.linked_lines(nodes, sizes, 90, fuzzy_lines.alike).collect()}
    assert {i: got.get(i, i) for i in n} == want


def test_few_lines_are_compared_letter_by_letter():
    """Lines of a few syllables share many segments, but no block of two parts."""
    from tallyfield.llm import edit_links

    rng = random.Random(6)
    parts = [b"the ", b"er", b"tion ", b"an", b"and ", b"of ", b"in", b"ing ", b"ed ", b"re", b"on", b"es "]
    base = [b"".join(rng.choice(parts) for _ in range(45))[:120] for _ in range(1500)]
    lines = base + [scattered(rng, x, 8) for x in base[:50]]
    asked = []

    def decide(i, j):
        asked.append((i, j))
        return fuzzy_lines.alike(lines[i], lines[j], 90)

    got = components(range(len(lines)), edit_links.links_of(lines, np.full(len(lines), 3), 90, decide))
    assert all(got[i] == got[1500 + i] for i in range(50) if fuzzy_lines.alike(lines[i], lines[1500 + i], 90))
    assert len(asked) < 200


@pytest.mark.parametrize("few,matches", [(64, 1 << 19), (1, 30)])
def test_lines_that_repeat_themselves_and_hot_pieces_equal_brute_force(monkeypatch, few, matches):
    from tallyfield.llm import edit_links

    monkeypatch.setattr(edit_links, "FEW", few)
    monkeypatch.setattr(edit_links, "MATCHES", matches)
    rng = random.Random(7)
    words = b"one common passage of words that all of these lines hold in their midst "
    lines = set()
    for n in (20, 60, 140):
        base = bytes(rng.choice(b"abcdef ") for _ in range(n))
        for again in (b"is one ", b"xy", words):
            lines |= {scattered(rng, base + again * k, rng.randrange(1, 20)) for k in (1, 2, 20, 21, 22) for _ in range(4)}
            lines |= {base + again * 5 + scattered(rng, base, 2) for _ in range(6)}
    lines = sorted(lines)
    rng.shuffle(lines)
    n = range(len(lines))
    want = components(n, [(i, j) for i in n for j in range(i) if fuzzy_lines.alike(lines[i], lines[j], 90)])
    got = edit_links.links_of(lines, np.full(len(lines), 3), 90, lambda i, j: fuzzy_lines.alike(lines[i], lines[j], 90))
    assert components(n, got) == want and len(set(want.values())) < len(lines)


def test_distances_of_many_pairs():
    from tallyfield.llm import edit_links

    rng = random.Random(1)
    for low, high in ((1, 64), (60, 70), (65, 128), (129, 192)):
        lines = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(low, high))) for _ in range(40)]
        lines += [scattered(rng, x, min(len(x), 4)) or b"a" for x in lines]
        size = np.array([len(x) for x in lines])
        held = np.frombuffer(b"".join(lines) + bytes(edit_links.PAD), np.uint8), np.cumsum(size) - size, size
        a, b = np.arange(80), np.append(np.arange(40, 80), np.arange(40))
        words = -(-size[b] // 64)
        for w in np.unique(words).tolist():
            got = edit_links._distances(held, a[words == w], b[words == w], w)
            assert got.tolist() == [levenshtein(lines[i], lines[j]) for i, j in zip(a[words == w], b[words == w], strict=True)]
