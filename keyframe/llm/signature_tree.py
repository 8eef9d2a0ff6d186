"""Signature trees over token sets, joined by dual traversal.

A leaf holds one set as an exact bitmap over the tokens that occur in two or
more sets of the block, and the set's size.  An inner node holds the OR of its
children's bitmaps and the range of their sizes.  No set below a node can
overlap a set below another in more tokens than the two bitmaps have bits in
common, so a pair of nodes whose common bits fall short of the least overlap
that their size ranges ask for is dropped with everything below it.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Links:
    """Union-find over row numbers or ids; remembers the links that joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> None:
        a0, b0 = self.find(a), self.find(b)
        if a0 != b0:
            if a0 > b0:
                a0, b0 = b0, a0
            self.up[b0] = a0
            self.made.append((a, b))


def bitmaps(tokens: list[np.ndarray]) -> np.ndarray:
    """One row of uint64 words per set, over tokens held by at least two sets."""
    n = len(tokens)
    lens = np.fromiter(map(len, tokens), np.int64, n)
    flat = np.concatenate(tokens) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), lens)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(s))) > 1
    number = np.cumsum(many) - 1
    kind = np.cumsum(new) - 1
    keep = many[kind]
    bit, who = number[kind[keep]], row[order[keep]]
    words = max(1, (int(many.sum()) + 63) // 64)
    out = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(out, (who, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in common of each row of a with each row of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, (1 << 18) // max(1, len(b)))  # words at a time, for bounded memory
    for w in range(0, a.shape[1], step):
        out += np.bitwise_count(a[:, None, w : w + step] & b[None, :, w : w + step]).sum(axis=2, dtype=np.int64)
    return out


class Tree:
    """Levels of nodes, leaves first; each level lists (bitmap, least size, largest size)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = [(bits, sizes, sizes)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))


def join(ids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], least, links: Links) -> None:
    """Link ids whose sets overlap in at least least(size, size) tokens.

    least(x, y) must not fall when x or y grows.  Pairs already joined are not looked at again.
    """
    n = len(ids)
    if n < 2 or len({links.find(int(i)) for i in ids}) == 1:
        return
    bits = bitmaps(tokens)
    if n > FANOUT:  # neighbours in the order share their first common token where possible, so ORs stay small
        any_bit = bits != 0
        word = any_bit.argmax(axis=1)
        low = bits[np.arange(n), word]
        order = np.lexsort((sizes, low & (~low + np.uint64(1)), word))
        ids, sizes, bits = ids[order], sizes[order], bits[order]
    tree = Tree(bits, sizes)
    top = len(tree.levels) - 1
    stack = [(top, np.array([0]), np.array([0]))]
    while stack:
        level, left, right = stack.pop()
        b, lo, hi = tree.levels[level]
        over = common_bits(b[left], b[right])
        fit = over >= least(lo[left][:, None], lo[right][None, :])
        if level == 0:
            for i, j in zip(*np.nonzero(fit), strict=True):
                x, y = int(left[i]), int(right[j])
                if x < y and ids[x] != ids[y]:
                    links.join(int(ids[x]), int(ids[y]))
            continue
        below = len(tree.levels[level - 1][1])
        for i, j in zip(*np.nonzero(fit), strict=True):
            x, y = int(left[i]), int(right[j])
            if x > y:
                continue
            cx = np.arange(x * FANOUT, min((x + 1) * FANOUT, below))
            cy = np.arange(y * FANOUT, min((y + 1) * FANOUT, below))
            if level == 1 and len({links.find(int(v)) for v in ids[cx]} | {links.find(int(v)) for v in ids[cy]}) == 1:
                continue
            stack.append((level - 1, cx, cy))
