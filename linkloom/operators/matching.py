"""How much of two texts matches, block by block, for many pairs at once.

The longest block that both texts share is found first (of equally long ones the one that ends first in the left text,
then in the right one), then the same on both sides of it. The ratio is twice the number of matched characters over the
length of both texts. All pairs of a batch advance together: one numpy step compares one character of every left text
with all of the right one.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd

#: From this length on the rule leaves out frequent characters; such texts are compared one pair at a time.
LONG = 200
#: Pairs that advance together.
TOGETHER = 4_096


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as rows, filled up to one width, and their lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _cut(codes: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, fill: int) -> np.ndarray:
    """The part from ``low`` to ``high`` of the rows ``pair``."""
    at = low[:, None] + np.arange(int((high - low).max()))
    inside = at < high[:, None]
    return np.where(inside, codes[pair[:, None], np.where(inside, at, 0)], fill)


def matched_characters(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair, the number of characters in matched blocks."""
    a, n_a = _codes(left, -1)
    b, n_b = _codes(right, -2)
    total = np.zeros(len(left), np.int64)
    pair = np.flatnonzero((n_a > 0) & (n_b > 0))
    a_low, a_high, b_low, b_high = np.zeros_like(pair), n_a[pair], np.zeros_like(pair), n_b[pair]
    while len(pair):
        x, y = _cut(a, pair, a_low, a_high, -1), _cut(b, pair, b_low, b_high, -2)
        # runs[:, j + 1]: how many characters before and with y[j] equal those before and with the current one of x
        runs = np.zeros((len(pair), y.shape[1] + 1), np.int64)
        best, at_x, at_y = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(x.shape[1]):
            runs[:, 1:] = np.where(y == x[:, i : i + 1], runs[:, :-1] + 1, 0)
            end = runs.argmax(axis=1)
            length = runs[np.arange(len(pair)), end]
            longer = length > best
            at_x = np.where(longer, i + 1 - length, at_x)
            at_y = np.where(longer, end - length, at_y)
            best = np.where(longer, length, best)
        np.add.at(total, pair, best)
        x_from, y_from = a_low + at_x, b_low + at_y
        sides = (
            (pair, a_low, x_from, b_low, y_from),
            (pair, x_from + best, a_high, y_from + best, b_high),
        )
        parts = [np.concatenate(p) for p in zip(*sides, strict=True)]
        found = np.tile(best > 0, 2) & (parts[1] < parts[2]) & (parts[3] < parts[4])
        pair, a_low, a_high, b_low, b_high = (p[found] for p in parts)
    return total


def ratios(left: pd.Series, right: pd.Series) -> np.ndarray:
    """The ratio of every pair of texts; of two empty ones it is 1."""
    size = left.str.len().to_numpy() + right.str.len().to_numpy()
    out = np.ones(len(left))
    long = (right.str.len() >= LONG).to_numpy()
    for k in np.flatnonzero(long):
        out[k] = SequenceMatcher(None, left.iloc[k], right.iloc[k]).ratio()
    # Texts of like length stand together, so that little is filled up.
    order = np.flatnonzero(~long & (size > 0))
    order = order[np.argsort(size[order], kind="stable")]
    for k in range(0, len(order), TOGETHER):
        some = order[k : k + TOGETHER]
        matched = matched_characters(left.iloc[some].tolist(), right.iloc[some].tolist())
        out[some] = 2.0 * matched / size[some]
    return out
