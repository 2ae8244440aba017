"""Nearest points by matrix products."""

from __future__ import annotations

#: Distances held at a time, 4 bytes each.
CELLS = 1 << 23
#: Columns of a strip of the product, and how many of them, spread over the strip, make a group whose least counts.
STRIP, GROUP = 4096, 32
#: Numbers of the pairs that are measured coordinate by coordinate at once, few enough to stay near the processor.
NUMBERS = 1 << 15


def _measured(a, b, i, j):
    """The distances of the pairs of rows i of a and j of b, coordinate by coordinate."""
    import numpy as np

    out, pairs = np.empty(len(i)), max(1, NUMBERS // max(1, a.shape[1]))
    for lo in range(0, len(i), pairs):
        part = slice(lo, lo + pairs)
        out[part] = np.sqrt(((a[i[part]] - b[j[part]]) ** 2).sum(axis=1))
    return out


def nearest_in_block(a, b, ids, k: int):
    """(distances, ids) of the k nearest of the rows of b for each row of a, by distance and then id.

    A matrix product gives distances but for rounding; what comes within rounding of the k-th is
    measured anew, coordinate by coordinate, so that equal points are equally far. Large blocks are
    multiplied in single precision, whose rounding is wider: the least of each group of columns bounds
    the k-th, and only groups that come within rounding of it are looked into.
    """
    import numpy as np

    k = min(k, len(b))
    out_d, out_i = np.empty((len(a), k)), np.empty((len(a), k), dtype=np.int64)
    if not len(a) or not k:
        return out_d, out_i
    middle = np.median(b[:: -(-len(b) // 1024)], axis=0)  # about: few far points do not move it
    far = max(np.abs(a - middle).max(), np.abs(b - middle).max(), 0) if len(b) >= 32 * k and len(b) > STRIP // 4 else np.inf
    found = _by_groups(a, b, middle, k) if 1e-12 < far < 1e12 else _by_cells(a, b, k)
    for lo, m, at, col in found:
        exact = _measured(a, b, lo + at, col)
        order = np.lexsort((ids[col], exact, at))
        at, col, exact = at[order], col[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)  # within its row
        first = place < k
        out_d[lo : lo + m], out_i[lo : lo + m] = exact[first].reshape(-1, k), ids[col[first]].reshape(-1, k)
    return out_d, out_i


def _by_cells(a, b, k: int):
    """(first row, number of rows, rows from there, columns) of what may be among the k nearest: by products in double precision."""
    import numpy as np

    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    step = min(256, max(16, CELLS // 4 // len(b)))
    for lo in range(0, len(a), step):
        rows = a[lo : lo + step]
        d = rows @ b.T  # then squared distances, less the row's own square
        d *= -2
        d += b2
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 * (1 + a2[lo : lo + step] + b2.max())
        yield (lo, len(rows), *np.nonzero(d <= limit[:, None]))


def _by_groups(a, b, middle, k: int):
    """The same in single precision, around the middle, by groups of columns."""
    import numpy as np

    n, width = len(b), a.shape[1]
    strips = -(-n // STRIP)
    per = STRIP // GROUP  # groups of a strip; group g holds the columns g, g + per, ...
    one = np.empty((len(a), width + 1), dtype=np.float32)
    one[:, :width], one[:, width] = (a - middle) * -2, 1
    two = np.zeros((strips * STRIP, width + 1), dtype=np.float32)
    two[:n, :width] = b - middle
    a2, b2 = (one[:, :width].astype(np.float64) ** 2).sum(axis=1) / 4, (two[:n, :width].astype(np.float64) ** 2).sum(axis=1)
    two[:n, width], two[n:, width] = b2, np.inf
    two = two.reshape(strips, STRIP, width + 1)
    largest = np.concatenate([b2, np.zeros(strips * STRIP - n)]).reshape(strips, GROUP, per).max(axis=1).ravel()
    # a product is off by (width + 8) roundings of |a|^2 + 2 |b|^2 at most, of single precision and then some, but for underflow
    unit = (width + 8) * 2.0**-24 * 1.01
    step = min(256, max(16, CELLS // (strips * STRIP)))
    d = np.empty((strips, min(step, len(a)), STRIP), dtype=np.float32)
    for lo in range(0, len(a), step):
        rows = one[lo : lo + step]
        m = len(rows)
        least = np.empty((m, strips * per))
        for s in range(strips):
            np.matmul(rows, two[s].T, out=d[s, :m])
            least[:, s * per : s * per + per] = d[s, :m].reshape(m, GROUP, per).min(axis=1)
        off = unit * (a2[lo : lo + step, None] + 2 * largest) + 1e-37
        limit = np.partition(least + off, k - 1, axis=1)[:, k - 1]
        at, g = np.nonzero(least - off <= limit[:, None])
        bound = limit[at] + off[at, g]
        s, g = np.divmod(g, per)
        cells = d[s[:, None], at[:, None], g[:, None] + per * np.arange(GROUP)]
        i, j = np.nonzero(cells <= bound[:, None])
        yield lo, m, at[i], s[i] * STRIP + g[i] + per * j


def squares_about(a, b, middle, largest: float = 0.0):
    """(left, a2, right, b2, unit, least): left @ right.T are the squared distances of the rows of a and b, less a2, the rows'
    own squares around the middle, off by unit * (a2 + 2 b2) + least at most: of single precision unless numbers are too far from 1.

    largest: a number that will be added or compared, squared, in the same precision.
    """
    import numpy as np

    width = a.shape[1]
    far = max((np.abs(x - middle).max(initial=0) for x in (a, b)), default=0)
    kind, step, least = (np.float32, 2.0**-24, 1e-37) if 1e-12 < far < 1e12 and largest < 1e12 else (np.float64, 2.0**-53, 1e-300)
    left, right = np.ones((len(a), width + 1), dtype=kind), np.empty((len(b), width + 1), dtype=kind)
    left[:, :width], right[:, :width] = (a - middle) * -2, b - middle
    a2, b2 = (left[:, :width].astype(np.float64) ** 2).sum(axis=1) / 4, (right[:, :width].astype(np.float64) ** 2).sum(axis=1)
    right[:, width] = b2
    unit = (width + 16) * step * 1.01
    return left, a2, right, b2, unit, least


class Nearest:
    """The distances to the k nearest of the rows of x, and the first few with their ids, among rows that come block by block.

    Memory is 2 k numbers a row, whatever comes. k may not be less than few.
    """

    ROWS = 256

    def __init__(self, x, k: int, few: int):
        import numpy as np

        self.x, self.k = x, k
        self.held, self.filled = np.empty((len(x), 2 * k)), np.zeros(len(x), dtype=np.int64)
        self.limit = np.full(len(x), np.inf)  # what is farther is not among the k nearest
        self.near, self.ids = np.full((len(x), few), np.inf), np.full((len(x), few), -1)
        self.middle = np.median(x[:: -(-len(x) // 1024)], axis=0)

    def _shrink(self, rows: slice):
        import numpy as np

        held, filled = self.held[rows, : self.filled[rows].max()], self.filled[rows]
        held[np.arange(held.shape[1]) >= filled[:, None]] = np.inf
        if held.shape[1] >= self.k:
            held.partition(self.k - 1, axis=1)
            self.limit[rows] = held[:, self.k - 1]
        self.filled[rows] = np.minimum(filled, self.k)

    def add(self, ids, b):
        import numpy as np

        if not len(b) or not len(self.x):
            return
        left, a2, right, b2, unit, least = squares_about(self.x, b, self.middle)
        off = 2 * (unit * (a2 + 2 * b2.max()) + least)
        for lo in range(0, len(self.x), self.ROWS):
            rows = slice(lo, lo + self.ROWS)
            d = left[rows] @ right.T
            bound = self.limit[rows] ** 2 - a2[rows] + off[rows]
            open_ = np.isinf(bound)
            if open_.any() and len(b) > self.k:
                bound[open_] = np.partition(d[open_], self.k - 1, axis=1)[:, self.k - 1] + off[rows][open_]
            at, column = np.divmod(np.flatnonzero(d <= np.nextafter(bound.astype(d.dtype), d.dtype.type(np.inf))[:, None]), len(b))
            if not len(at):
                continue
            self._take(rows, lo + at, ids[column], _measured(self.x, b, lo + at, column))

    def _take(self, rows: slice, at, ids, exact):
        import numpy as np

        lo = rows.start
        nearer = np.flatnonzero(exact <= self.near[at, -1])
        if len(nearer):
            some = np.unique(at[nearer])
            few = self.near.shape[1]
            every = np.concatenate([np.repeat(some, few), at[nearer]])
            far, names = np.concatenate([self.near[some].ravel(), exact[nearer]]), np.concatenate([self.ids[some].ravel(), ids[nearer]])
            order = np.lexsort((names, far, every))
            every, far, names = every[order], far[order], names[order]
            first = np.arange(len(every)) - np.searchsorted(every, every) < few
            self.near[some], self.ids[some] = far[first].reshape(-1, few), names[first].reshape(-1, few)
        if np.bincount(at - lo).max() > self.k:
            order = np.lexsort((exact, at))
            at, exact = at[order], exact[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < self.k
            at, exact = at[first], exact[first]
        more = np.bincount(at - lo, minlength=len(self.filled[rows]))
        if (self.filled[rows] + more).max() > self.k + self.k // 4:
            self._shrink(rows)
        place = self.filled[rows] - np.cumsum(more) + more  # of a row's first, less what comes before
        self.held[at, place[at - lo] + np.arange(len(at))] = exact
        self.filled[rows] += more
        if (np.isinf(self.limit[rows]) & (self.filled[rows] >= self.k)).any():
            self._shrink(rows)

    def last(self):
        """The distance to the k-th nearest of each row; the farthest where fewer came."""
        import numpy as np

        for lo in range(0, len(self.x), self.ROWS):
            self._shrink(slice(lo, lo + self.ROWS))
        return np.where(np.isfinite(self.limit), self.limit, np.where(np.arange(2 * self.k) < self.filled[:, None], self.held, 0).max(axis=1))
