"""Byte-level BPE over whole batches.

A text is cut at the file's added tokens, each of which is one id, and then into
pieces by the vocabulary's own pattern, on arrays of
character classes; each distinct piece of a slice is encoded once and its ids
are gathered for all its occurrences.  Results equal `tokenizers`' (tested).
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from .common import slices, span_hashes, worker_cache

#: The code points that the vocabulary's splitting pattern counts as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
CACHED = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself, or the next of 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[SPACES] = SPACE
    return t


class Encoder:
    """Ids of the byte-level BPE vocabulary in a `tokenizers` JSON file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens", [])
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.find_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in word): i for word, i in file["model"]["vocab"].items() if all(c in back for c in word) and i not in self.added.values()}
        whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # the pieces are cut here
        self.piece = whole.encode_ordinary
        self.classes = character_classes()
        self.known: dict[int, tuple[int, ...]] = {}

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; first marks the first character of each text."""
        n = len(points)
        kind = self.classes[points]
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        blank = np.zeros(n, bool)
        blank[1:] = (points[:-1] == 32) & ~first[1:]
        space = kind == SPACE
        out = new & (space | ~blank)
        last = np.zeros(n, bool)  # last white space before something else
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        out |= last
        quote = np.flatnonzero((points == 39) & out)
        if len(quote):
            inside = np.append(points, [0, 0, 0])
            stop = np.append(first, [True, True, True])
            a = np.where(stop[quote + 1], 0, inside[quote + 1])
            b = np.where(stop[quote + 1] | stop[quote + 2], 0, inside[quote + 2])
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.isin(a * 65536 + b, [ord(x) * 65536 + ord(y) for x, y in ("re", "ve", "ll")])
            for hit, length in ((one, 2), (two, 3)):
                q = quote[hit]
                out[q + 1] = False
                end = q[q + length < n] + length
                out[end[~space[end]]] = True
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids, int64 offsets) of the rows of one slice."""
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        rows = np.searchsorted(at, offs)
        first = np.zeros(len(points) + 1, bool)
        first[rows] = True
        raw = data.tobytes()
        spans = [(m.start(), m.end()) for lo, hi in zip(offs[:-1], offs[1:], strict=True) for m in self.find_added.finditer(raw, lo, hi)] if self.find_added and self.find_added.search(raw) else []
        spans = np.searchsorted(at, np.array(spans, np.int64).reshape(-1, 2))
        first[spans] = True
        begin = self.starts(points, first[:-1])
        for s, e in spans:
            begin[s + 1 : e] = False
        begin = np.flatnonzero(begin)
        b = at[begin]
        e = np.append(b[1:], len(data))
        uniq, where, inverse = np.unique(span_hashes(data, b, e, 101), return_index=True, return_inverse=True)
        known = self.known
        if len(known) > CACHED:
            known.clear()
        pieces = []
        for h, i in zip(uniq.tolist(), where.tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                piece = raw[b[i] : e[i]]
                ids = known[h] = (self.added[piece],) if piece in self.added else tuple(self.piece(piece.decode()))
            pieces.append(ids)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.array(list(chain.from_iterable(pieces)), np.uint32)
        base = np.cumsum(size) - size
        take = size[inverse]
        end = np.cumsum(take)
        out = flat[np.arange(int(end[-1])) - np.repeat(end - take, take) + np.repeat(base[inverse], take)]
        return out, np.append(0, end)[np.searchsorted(begin, rows)]


def encoder(path: str) -> Encoder:
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Encoder(path)
    return cache["bpe", path]


def token_rows(path: str, data: np.ndarray, offs: np.ndarray):
    """The uint32 ids of each row, slice by slice."""
    enc = encoder(path)
    for lo, hi in slices(offs, 2 << 20):
        ids, at = enc.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        for r in range(hi - lo):
            yield ids[at[r] : at[r + 1]]
