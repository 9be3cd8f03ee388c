"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns give the base spans: e-mail, IPv4, payment card (Luhn) and international phone number, leftmost and non-overlapping for
each kind; a match that fails its test is dropped. They stay whatever the model says. The model adds what the patterns miss, such as
numbers without a plus sign and spelled-out addresses.

The model works on windows: runs of tokens with a digit or @ or of a spelled-out address, with CONTEXT tokens on either side. A segmentation
covers a window by segments of 1 to MOST tokens of a kind (a spelled-out address may have more), or single outside tokens; each segment is scored by features of the whole span (checksum,
digits, shape, separators, words before and behind) and of the kind before. Training maximises the conditional likelihood by
forward-backward over all segmentations; decoding takes the best one by the same recursion with maxima.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, text_array, texts_of

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
MOST, CONTEXT = 4, 2
#: Texts that training reads at most, chosen by a hash of their id among those with a digit or @; and windows of them.
TRAIN_TEXTS, TRAIN_WINDOWS = 600, 400

# fixed patterns of the base spans
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
# spelled-out addresses: from the "at" on, and the name before it, looked for in _BACK characters
_DOT = r"(?:\.|\s{1,3}dot\s{1,3}|\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3})"
_AT_HOST = re.compile(r"(?i)(?:(?<=\s)at(?=\s)|[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>])\s{0,3}[\w-]{1,63}(?:" + _DOT + r"[\w-]{1,63})*?" + _DOT
                      + r"[^\W\d_]{2,24}(?![\w@-])(?!\.\w)(?!\s{1,3}dot\s{1,3}\w)(?!\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}\w)")
_NAME = re.compile(r"(?i)[\w%+-]{1,64}(?:" + _DOT + r"[\w%+-]{1,64})*(?=\s{0,3}\Z)")
_BACK = 200
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    out = []
    if "@" in text:
        # a match holds no white space: each token with @ is searched alone
        at = text.find("@")
        while at >= 0:
            lo, hi = at, at
            while lo and not text[lo - 1].isspace():
                lo -= 1
            while hi < len(text) and not text[hi].isspace():
                hi += 1
            out += [(lo + m.start(), 0, lo + m.end()) for m in _EMAIL.finditer(text[lo:hi])]
            at = text.find("@", hi)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def spelled_out(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Places of what may be spelled-out addresses, such as ``jane.doe at example dot com``, in order and apart."""
    out: list[tuple[int, int]] = []
    for m in _AT_HOST.finditer(text, start, len(text) if end is None else end):
        low = max(start, m.start() - _BACK, out[-1][1] if out else 0)
        name = _NAME.search(text[low:m.start()])
        if name:
            out.append((low + name.start(), m.end()))
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token places of the runs of tokens with a digit or @ or of a spelled-out address, and their neighbours."""
    spelled = spelled_out(text)
    if not spelled and not _SIGN.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    marked = {i for i, (a, b) in enumerate(tokens) if _SIGN.search(text, a, b)}
    for a, b in spelled:
        marked.update(_tokens_at(tokens, a, b))
    out: list[list[int]] = []
    for i in sorted(marked):
        lo, hi = max(0, i - CONTEXT), min(len(tokens), i + CONTEXT + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tokens[a:b] for a, b in out]


def _tokens_at(tokens: list[tuple[int, int]], start: int, end: int) -> range:
    """Numbers of the tokens that a span touches."""
    return range(bisect_right(tokens, start, key=lambda t: t[1]), bisect_left(tokens, end, key=lambda t: t[0]))


_EDGE = ".,;:!?\"'()[]{}<>|"
# words that stand beside personal data, by kind
_CUES = (("mail", "email", "e-mail", "contact", "write"), ("ip", "host", "server", "address", "addr"),
         ("card", "visa", "credit", "payment", "pay"), ("phone", "tel", "call", "mobile", "fax", "cell"))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without punctuation at its ends; a closing bracket stays if its opening one does."""
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def span_features(text: str, start: int, end: int, tokens: int, before: str, behind: str) -> np.ndarray:
    """Features of a whole candidate span; the last is constant."""
    s = text[start:end]
    d = _digits(s)
    n = len(d)
    letters = sum(c.isalpha() for c in s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    octets = s.split(".")
    around = before.lower(), behind.lower()
    cues = [float(any(w.strip(_EDGE) in cue for w in around)) for cue in _CUES]
    address = _EMAIL.fullmatch(s) is not None
    found = spelled_out(s)
    spelled = bool(re.fullmatch(r"[\w.%+-]+\W{1,3}(?:at|@)\W{1,3}[\w-]+(?:\.|\W{1,3}dot\W{1,3})[\w.-]+", s)) or found == [(0, len(s))]
    return np.array([
        address, "@" in s, spelled,
        len(octets) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in octets), s.count(".") == 3,
        14 <= n <= 19 and not letters, 14 <= n <= 19 and not letters and luhn(d), 10 <= n <= 15 and not letters,
        s[:1] == "+", "(" in s and ")" in s, "-" in s, len(groups) in (3, 4) and not letters,
        len(groups) >= 2 and len(groups[-1]) == 4 and not letters, 7 <= n <= 9 and not letters, 0 < n < 7, n == 0, n > 19, letters > 0,
        bool(re.fullmatch(r"[0-9a-f]{8,}", s)) and letters > 0, not all(c in "0123456789 ().+-" for c in s),
        spelled and bool(re.search(r"(?i)\bdot\b|[\[({<]\s*(at|@)", s)), spelled and bool(re.match(r"\w+[.\d_%+-]", s)),
        *(tokens == k for k in range(1, MOST + 1)), *cues, 1.0], float)


WIDTH = len(span_features("1", 0, 1, 1, "", ""))


class Window:
    """All segments of a window: ``places[k]`` = (first token, tokens behind, start, end), ``x[k]`` its features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n, self.places, x = len(tokens), [], []
        spelled: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in spelled_out(text, tokens[0][0], tokens[-1][1]):
            at = _tokens_at(tokens, a, b)
            spelled.setdefault(at[0], []).append((at[-1] + 1, a, b))
        for i in range(self.n):
            each = []
            for j in range(i + 1, min(self.n, i + MOST) + 1):
                a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
                if a >= b:
                    a, b = tokens[i][0], tokens[j - 1][1]
                each.append((j, a, b))
            for j, a, b in each + [s for s in spelled.get(i, []) if s not in each]:
                self.places.append((i, j, a, b))
                word = lambda k: text[slice(*tokens[k])] if 0 <= k < self.n else ""
                x.append(span_features(text, a, b, j - i, word(i - 1), word(j)))
        self.x = np.array(x)
        self.ending = [[k for k, p in enumerate(self.places) if p[1] == j] for j in range(self.n + 1)]

    def allowed(self) -> np.ndarray:
        """segments x kinds: outside segments have one token; the others meet what their kind cannot do without."""
        email, spelled, octets = self.x[:, 0], self.x[:, 2], self.x[:, 3]
        luhn_valid, long, short, lettered = self.x[:, 6], self.x[:, 7], self.x[:, 13], self.x[:, 19]
        single = [j - i == 1 for i, j, *_ in self.places]
        return np.stack([(email + spelled) > 0, octets > 0, luhn_valid > 0, ((long + short) > 0) & (lettered == 0), single], axis=1)


@dataclass(frozen=True)
class SemiCrf:
    weights: np.ndarray = field(repr=False)  # kinds x features
    moves: np.ndarray = field(repr=False)  # kind before x kind

    def scores(self, w: Window) -> np.ndarray:
        return np.where(w.allowed(), w.x @ self.weights.T, -np.inf)

    def decode(self, w: Window) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation's spans."""
        s = self.scores(w)
        best = np.full((w.n + 1, OUTSIDE + 1), -np.inf)
        best[0, OUTSIDE] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, w.n + 1):
            for k in w.ending[j]:
                reach = best[w.places[k][0]][:, None] + self.moves
                prior = reach.argmax(0)
                total = reach.max(0) + s[k]
                for c in np.flatnonzero(total > best[j]):
                    best[j, c] = total[c]
                    back[j, int(c)] = (k, int(prior[c]))
        out, j, c = [], w.n, int(best[w.n].argmax())
        while j:
            k, before = back[j, c]
            if c != OUTSIDE:
                out.append((w.places[k][2], c, w.places[k][3]))
            j, c = w.places[k][0], before
        return out[::-1]

    def gradient(self, w: Window, gold: list[tuple[int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of ``gold`` (segment, kind) and its gradients, by forward-backward."""
        s, kinds = self.scores(w), OUTSIDE + 1
        ahead = np.full((w.n + 1, kinds), -np.inf)
        ahead[0, OUTSIDE] = 0
        for j in range(1, w.n + 1):
            rows = [_log_sum(ahead[w.places[k][0]][:, None] + self.moves, 0) + s[k] for k in w.ending[j]]
            ahead[j] = _log_sum(np.array(rows), 0)
        behind = np.full((w.n + 1, kinds), -np.inf)
        behind[w.n] = 0
        starting: list[list[int]] = [[] for _ in range(w.n + 1)]
        for k, p in enumerate(w.places):
            starting[p[0]].append(k)
        for i in range(w.n - 1, -1, -1):
            rows = [_log_sum(self.moves + (s[k] + behind[w.places[k][1]])[None, :], 1) for k in starting[i]]
            behind[i] = _log_sum(np.array(rows), 0)
        total = _log_sum(ahead[w.n], 0)
        g, moves, value = np.zeros_like(self.weights), np.zeros_like(self.moves), -float(total)
        for k, (i, j, *_) in enumerate(w.places):
            joint = np.exp(ahead[i][:, None] + self.moves + (s[k] + behind[j])[None, :] - total)
            g -= np.outer(joint.sum(0), w.x[k])
            moves -= joint
        before = OUTSIDE
        for k, c in gold:
            g[c] += w.x[k]
            moves[before, c] += 1
            value += float(s[k, c] + self.moves[before, c])
            before = c
        return value, g, moves


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis)) + safe


def gold_of(w: Window, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]] | None:
    """The segmentation that has just ``spans``; None if one of them is no segment of the window."""
    place = {(a, b): k for k, (_, _, a, b) in reversed(list(enumerate(w.places)))}
    inside: dict[int, tuple[int, int]] = {}
    for start, kind, end in spans:
        k = place.get((start, end))
        if k is None:
            return None
        inside[w.places[k][0]] = (k, kind)
    single = {p[0]: k for k, p in enumerate(w.places) if p[1] - p[0] == 1}
    out, i = [], 0
    while i < w.n:
        k, kind = inside.get(i, (single[i], OUTSIDE))
        out.append((k, kind))
        i = w.places[k][1]
    return out


def examples(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[Window, list[tuple[int, int]]]]:
    out = []
    for tokens in windows(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        w = Window(text, tokens)
        gold = gold_of(w, [x for x in spans if lo <= x[0] and x[2] <= hi])
        if gold is not None:
            out.append((w, gold))
    return out


def written_otherwise(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The same text with e-mail addresses spelled out and numbers in other usual forms, so that training sees them too."""
    parts, out, at, grown = [], [], 0, 0
    for start, kind, end in spans:
        if start < at:
            continue
        old = text[start:end]
        new = old
        if kind == 0:
            name, _, host = old.partition("@")
            # by the name's length: the sign alone, the dots too, or both in brackets
            new = (f"{name} at {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}")[len(name) % 3]
        elif kind == 2 and len(old) == 16 and old.isdigit():
            new = " ".join(old[i:i + 4] for i in range(0, 16, 4))
        elif kind == 3:
            new = old.lstrip("+").replace("(", "").replace(")", "")
        parts += [text[at:start], new]
        out.append((start + grown, kind, start + grown + len(new)))
        grown += len(new) - len(old)
        at = end
    return "".join([*parts, text[at:]]), out


def train(texts: list[str], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> SemiCrf:
    """Fit on texts whose base spans serve as labels, each also in other usual spellings, by AdaGrad."""
    data = []
    for t in texts:
        spans = _disjoint(base_spans(t))
        data += examples(t, spans)
        if spans:
            data += examples(*written_otherwise(t, spans))
        if len(data) >= TRAIN_WINDOWS:
            break
    weights, moves = np.zeros((OUTSIDE + 1, WIDTH)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    weights[OUTSIDE, -1] = 1.0  # untrained, everything is outside
    g2w, g2m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(epochs if data else 0):
        for w, gold in data[:TRAIN_WINDOWS]:
            _, g, m = SemiCrf(weights, moves).gradient(w, gold)
            g -= ridge * weights
            m -= ridge * moves
            g2w += g * g
            g2m += m * m
            weights = weights + rate * g / np.sqrt(g2w)
            moves = moves + rate * m / np.sqrt(g2m)
    return SemiCrf(weights, moves)


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for x in spans:
        if not out or x[0] >= out[-1][2]:
            out.append(x)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SemiCrf:
    """Learn from at most TRAIN_TEXTS texts of up to 20,000 characters with a digit or @, chosen by a hash of their ids."""
    rows = texts_of(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20_000))
    # the ids alone are sorted; at most TRAIN_TEXTS of them are sent to the tasks, and their texts to the driver
    chosen = (rows.select(F.col("doc_id").alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen")
              .limit(TRAIN_TEXTS).distinct())
    texts = (rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text")
             .limit(TRAIN_TEXTS).collect())
    return train([r["text"] for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"]))])


def all_spans(text: str, model: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the model's spans that touch none of them."""
    base = base_spans(text)
    covered = sorted((a, b) for a, _, b in base)
    added = []
    for tokens in windows(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        near = [(a, b) for a, b in covered if a < hi and b > lo]
        for a, kind, b in model.decode(Window(text, tokens)):
            if all(b <= x or a >= y for x, y in near) and (kind == 0 or _SIGN.search(text, a, b)):
                added.append((a, kind, b))
    return base, sorted(base + added)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame, model: SemiCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    ``spans`` is kind:start:end of all spans by start, then kind, in code points, end exclusive. A null or empty text has none.
    Rows that repeat a doc_id are searched each; an empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for rb in batches:
            rows = []
            for text in text_array(rb.column("text")).to_pylist():
                base, every = all_spans(text, model)
                rows.append((*(sum(s[1] == k for s in base) for k in range(len(KINDS))),
                             hashlib.sha256(named(base).encode()).hexdigest(), named(every), len(every) - len(base)))
            yield batch(names, [rb.column("doc_id"), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 7)], types)

    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                                "spans string, n_added long")
