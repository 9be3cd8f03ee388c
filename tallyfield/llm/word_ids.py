"""Token ids of whole texts by a public word-level BPE vocabulary, one white-space-free piece at a time.

The vocabulary's pre-tokenizer never lets a token cross a space, tab or line end, so the ids of a text are those of its pieces in
order, and a worker encodes each different piece once per batch. ``CACHE`` pieces stay known between batches.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

#: Pieces that a worker keeps; further ones are encoded again in each batch.
CACHE = 600_000
#: For UTF-8 bytes: tabs and line ends to spaces, with A-Z lower-cased. Far faster than the same on a text that is not all ASCII.
_FOLDED = bytes(32 if b in b"\t\n\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache
def _known(path: str) -> dict[str, bytes]:
    return {"": b""}


def pieces_of(text: str) -> list[str]:
    """What spaces, tabs and line ends separate, A-Z lower-cased (the vocabulary folds case) unless a special token's
    name may stand in the text."""
    if "<|" not in text:
        return text.encode().translate(_FOLDED).decode().split(" ")
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    known = _known(path)
    split = [pieces_of(t) for t in texts]
    new = set().union(*split) - known.keys()
    table = known
    if new:
        # a full stop or comma behind a letter is a token of its own
        cut = {p for p in new if p[-1] in ".," and p[-2:-1].isalpha()}
        stems = {p[:-1] for p in cut}
        stems.update((".", ","), new - cut)
        fresh = [p for p in stems if p not in known]
        encoded = _tokenizer(path).encode_batch_fast(fresh, add_special_tokens=False)
        added = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(fresh, encoded, strict=True)}
        for p in cut:
            stem, mark = p[:-1], p[-1]
            added[p] = ((added.get(stem) or known.get(stem, b"")) + (added.get(mark) or known[mark]))
        if len(known) + len(added) <= CACHE:
            known.update(added)
        else:
            table = _Both(known, added)
    return [b"".join(map(table.__getitem__, pieces)) for pieces in split]


class _Both(dict):
    """A batch's pieces, then the kept ones."""

    def __init__(self, known: dict[str, bytes], added: dict[str, bytes]):
        super().__init__(added)
        self.known = known

    def __missing__(self, piece: str) -> bytes:
        return self.known[piece]
