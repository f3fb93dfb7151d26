"""Edit distances of many pairs of strings at once: bit vectors of 64 rows of the table, a column at a time for all pairs."""

from __future__ import annotations

import numpy as np

from .common import U64


def _shared(x: str, y: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _trimmed(x: str, y: str) -> tuple[str, str]:
    """What the strings don't share at their ends, the shorter first."""
    n = _shared(x, y)
    x, y = x[n:], y[n:]
    n = _shared(x[::-1], y[::-1])
    x, y = x[: len(x) - n], y[: len(y) - n]
    return (x, y) if len(x) <= len(y) else (y, x)


def _within(x: str, y: str, most: int) -> bool:
    """The same for one pair, over Python's long integers: for strings so long that a column costs more than its calls."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << len(x) - 1
    up, down, score = full, 0, len(x)
    for left, c in zip(range(len(y), 0, -1), y, strict=True):
        if not score - left <= most < score + left:
            break
        eq = at.get(c, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | ~(d | up) & full, up & d
        score += bool(hp & last) - bool(hn & last)
        hp, hn = hp << 1 | 1, hn << 1
        up, down = (hn | ~(d | hp)) & full, hp & d & full
    return score <= most


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _same_width(x: list[str], y: list[str], most: np.ndarray, width: int) -> np.ndarray:
    """Whether each distance is `most` or less; x has up to 64 * width characters, y comes longest first. Only blocks of
    rows that a path of so few edits can touch are followed; what lies outside counts as an edit for each row."""
    n_pairs = len(x)
    m, n = (np.array([len(s) for s in t]) for t in (x, y))
    cx, cy = _codes(x), _codes(y)
    seen = np.zeros(0x110000, bool)
    seen[cx] = seen[cy] = True
    chars = np.flatnonzero(seen)
    code = np.zeros(int(chars[-1]) + 1, np.int64)
    code[chars] = np.arange(len(chars))
    cx, cy = code[cx], code[cy]
    row = np.repeat(np.arange(n_pairs), m)
    place = np.arange(len(cx)) - np.repeat(np.cumsum(m) - m, m)
    equal = np.zeros(n_pairs * len(chars) * width, U64)  # by pair, character and block, the rows with that character
    np.add.at(equal, (row * len(chars) + cx) * width + (place >> 6), U64(1) << (place & 63).astype(U64))
    columns = np.zeros((n[0], n_pairs), np.int64)
    row = np.repeat(np.arange(n_pairs), n)
    columns[np.arange(len(cy)) - np.repeat(np.cumsum(n) - n, n), row] = (row * len(chars) + cy) * width
    up, down = np.full((width, n_pairs), ~U64(0)), np.zeros((width, n_pairs), U64)
    last = U64(1) << ((m - 1) & 63).astype(U64)
    ends = np.repeat(np.minimum(64 * np.arange(1, width + 1), 64 * width)[:, None], n_pairs, 1)
    ends[-1] = m
    score, pair, out = ends.copy(), np.arange(n_pairs), np.zeros(n_pairs, bool)  # of each block's last row
    reach, first = int(most.max()), 0
    bottom = min(width - 1, reach >> 6)
    for j in range(int(n[0])):
        if j % 16 == 0 and bottom == width - 1:  # a column changes a distance by one at most
            left = n - j
            open_ = (score[-1] - left <= most) & (score[-1] + left > most)
            if 4 * open_.sum() < 3 * len(pair):
                out[pair[~open_]] = (score[-1] <= most)[~open_]
                pair, n, most, last = (v[open_] for v in (pair, n, most, last))
                up, down, columns, score, ends = (v[:, open_] for v in (up, down, columns, score, ends))
                if not len(pair):
                    return out
        first, new = max(0, j - reach) >> 6, min(width - 1, (j + 1 + reach) >> 6)
        for b in range(bottom + 1, new + 1):
            score[b] = score[b - 1] + ends[b] - ends[b - 1]
        bottom = new
        live = int(np.searchsorted(-n, -j, "left"))  # those longer than j
        at = columns[j, :live]
        plus, minus = U64(1), U64(0)
        for b in range(min(first, bottom), bottom + 1):
            eq, pv, mv = equal[at + b], up[b, :live], down[b, :live]
            xv = eq | mv
            eq |= minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            carry = ph >> U64(63), mh >> U64(63)
            if b == width - 1:
                score[b, :live] += (ph & last[:live]) != 0
                score[b, :live] -= (mh & last[:live]) != 0
            else:
                score[b, :live] += (carry[0] - carry[1]).view(np.int64)
            ph, mh = ph << U64(1) | plus, mh << U64(1) | minus
            up[b, :live], down[b, :live] = mh | ~(xv | ph), ph & xv
            plus, minus = carry
    out[pair] = score[-1] <= most
    return out


def _in_place(x: str, y: str, most: int) -> bool:
    """Whether as many words stand in both, and those that differ in place have `most` characters or less."""
    v, w = x.split(" "), y.split(" ")
    return len(v) == len(w) and sum([max(len(a), len(b)) for a, b in zip(v, w, strict=True) if a != b]) <= most


def within(xs: list[str], ys: list[str], most: np.ndarray, cells: int = 8192, widest: int = 64, few: int = 8) -> np.ndarray:
    """For each pair whether its Levenshtein distance is `most` or less. `cells` bounds what is held at once: pairs times
    blocks of 64 characters; pairs of more than `widest` blocks, and those that fewer than `few` times as many pairs share
    the number of blocks with, are taken one by one, which takes less time."""
    most = np.asarray(most, np.int64)
    out = np.zeros(len(xs), bool)
    pairs = [_trimmed(x, y) for x, y in zip(xs, ys, strict=True)]
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    short = m == 0
    out[short] = n[short] <= most[short]
    todo = np.flatnonzero(~short & (n - m <= most))
    out[todo] = [_in_place(*pairs[i], int(most[i])) for i in todo]
    todo = todo[~out[todo]]
    width = -(-m[todo] // 64)
    for i in todo[width > widest]:
        out[i] = _within(*pairs[i], int(most[i]))
    todo, width = todo[width <= widest], width[width <= widest]
    order = np.lexsort((-n[todo], most[todo] // 16, width))
    todo, width = todo[order], width[order]
    begin = 0
    while begin < len(todo):
        w = int(width[begin])
        end = int(np.searchsorted(width, w, "right"))
        if end - begin < few * w:
            for i in todo[begin:end]:
                out[i] = _within(*pairs[i], int(most[i]))
            begin = end
            continue
        end = min(end, begin + max(1, cells // w))
        own = todo[begin:end][np.argsort(-n[todo[begin:end]], kind="stable")]
        out[own] = _same_width([pairs[i][0] for i in own], [pairs[i][1] for i in own], most[own], w)
        begin = end
    return out
