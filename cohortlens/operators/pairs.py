"""Distances between the rows of two blocks, as one task takes them.

A tile of squared distances is one matrix product, |x|^2 - 2 x.y + |y|^2, which
is several times faster than a difference per coordinate but loses digits. So a
product only decides what is clear of its rounding; whatever lies within
``margin`` of a limit is taken again by differences, coordinate by coordinate,
and so are distances that are small beside the rows. Rows with components that
are not finite are taken by differences altogether.

``Blocks`` cuts the rows of a task by median splits into pieces with boxes, so
that pieces that are too far apart are passed over, and pieces that lie within
the limit altogether are counted without a distance.
"""

from __future__ import annotations

import numpy as np

TILE_A, TILE_B = 256, 512   # a tile of doubles stays in the core's cache
PIECE = 256                 # rows of a piece
QUERY = 1024                # rows that look for their nearest together
MARGIN = 1e-13              # of the squared norms: what a product may be off
SMALL = 1e-7                # of the squared norms: below, a root would show the product's rounding


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``a[i]`` and ``b[i]``, summed coordinate by coordinate."""
    acc = np.zeros(len(a))
    for j in range(a.shape[1]):
        diff = a[:, j] - b[:, j]
        acc += diff * diff
    return acc


def sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left factor, right factor, squared norms) of the product that gives squared distances."""
    n2 = (x * x).sum(axis=1)
    one = np.ones((len(x), 1))
    return np.hstack([-2 * x, n2[:, None], one]), np.hstack([x, one, n2[:, None]]), n2


class Blocks:
    """Rows in the order of ``order``, in pieces from ``start[i]`` to ``start[i + 1]`` with boxes ``lo``, ``hi``."""

    def __init__(self, x: np.ndarray, piece: int = PIECE):
        done, todo = [], [np.arange(len(x))] if len(x) else []
        while todo:
            at = todo.pop()
            if len(at) > piece:
                own = x[at]
                j = int((own.max(axis=0) - own.min(axis=0)).argmax())
                half = np.argpartition(own[:, j], len(at) // 2)
                todo += [at[half[len(at) // 2:]], at[half[:len(at) // 2]]]
            else:
                done.append(at)
        self.order = np.concatenate(done) if done else np.zeros(0, np.int64)
        self.start = np.append(0, np.cumsum([len(a) for a in done])).astype(np.int64)
        self.x = x[self.order]
        self.left, self.right, self.n2 = sides(self.x)
        self.finite = bool(np.isfinite(self.n2).all())
        d = x.shape[1]
        self.lo = np.array([self.x[s:e].min(axis=0) for s, e in self.spans()]).reshape(-1, d)
        self.hi = np.array([self.x[s:e].max(axis=0) for s, e in self.spans()]).reshape(-1, d)

    def spans(self):
        return zip(self.start[:-1], self.start[1:])

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Squared distance of each piece's box to the box ``lo``, ``hi``."""
        gap = np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0.0)
        return (gap * gap).sum(axis=1)

    def least_of(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row of ``x`` to each piece's box."""
        out = np.zeros((len(x), len(self.lo)))
        for j in range(x.shape[1]):
            col = x[:, j, None]
            gap = np.maximum(self.lo[:, j] - col, col - self.hi[:, j])
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            out += gap
        return out

    def most(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Greatest squared distance of a point in each piece's box to one in ``lo``, ``hi``."""
        gap = np.maximum(self.hi - lo, hi - self.lo)
        return (gap * gap).sum(axis=1)


def found(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few true cells of ``mask``, row by row."""
    return np.divmod(np.flatnonzero(mask.reshape(-1)), mask.shape[1])


def margin_of(*norms: np.ndarray) -> float:
    return MARGIN * sum(float(n.max(initial=0.0)) for n in norms)


def _runs(pieces: np.ndarray, start: np.ndarray, most: int = TILE_B):
    """Row ranges of neighbouring ``pieces`` (ascending), joined up to ``most`` rows."""
    i = 0
    while i < len(pieces):
        j = i + 1
        while j < len(pieces) and pieces[j] == pieces[j - 1] + 1 and start[pieces[j] + 1] - start[pieces[i]] <= most:
            j += 1
        yield int(start[pieces[i]]), int(start[pieces[j - 1] + 1])
        i = j


def count_within(x: np.ndarray, y: Blocks, eps2: float, enough: int | None = None) -> tuple[np.ndarray, int]:
    """(rows of ``y`` with squared distance <= eps2 for each row of ``x``; distances taken).

    ``enough``: rows that have so many need not be counted further.
    """
    q = Blocks(x)
    n, taken = np.zeros(len(x), np.int64), 0
    if not q.finite or not y.finite:
        for s in range(0, len(q.x), TILE_A):
            for t in range(0, len(y.x), TILE_B):
                n[s:s + TILE_A] += (_by_differences(q.x[s:s + TILE_A], y.x[t:t + TILE_B]) <= eps2).sum(axis=1)
        taken = len(q.x) * len(y.x)
    else:
        slack = margin_of(q.n2, y.n2)
        size = np.diff(y.start)
        for p, (s, e) in enumerate(q.spans()):
            low = y.least(q.lo[p], q.hi[p])
            inside = y.most(q.lo[p], q.hi[p]) <= eps2 - slack
            n[s:e] += int(size[inside].sum())
            near = np.flatnonzero((low <= eps2 + slack) & ~inside)
            own = np.arange(s, e)
            if enough is not None:
                near = near[np.argsort(low[near], kind="stable")]
                own = own[n[own] < enough]
                box = y.least_of(q.x[s:e]) if len(near) and len(own) else None
                ranges = ((int(y.start[i]), int(y.start[i + 1]), i) for i in near)
            else:
                ranges = ((t, u, None) for t, u in _runs(near, y.start))
            for t, u, i in ranges:
                if not len(own):
                    break
                ask = own if i is None else own[box[own - s, i] <= eps2 + slack]     # rows near the piece
                if not len(ask):
                    continue
                d2 = q.left[ask] @ y.right[t:u].T
                taken += d2.size
                n[ask] += _hits(d2, eps2, slack, lambda i, j: exact(q.x[ask[i]], y.x[t + j])).sum(axis=1)  # noqa: B023
                if enough is not None:
                    own = own[n[own] < enough]
    out = np.empty(len(x), np.int64)
    out[q.order] = n
    return out, taken


def _hits(d2: np.ndarray, eps2: float, slack: float, true) -> np.ndarray:
    """d2 <= eps2, by ``true(i, j)`` where that is within the product's rounding."""
    hit, sure = d2 <= eps2 + slack, d2 <= eps2 - slack
    if np.count_nonzero(hit) != np.count_nonzero(sure):
        i, j = found(hit & ~sure)
        hit[i, j] = true(i, j) <= eps2
    return hit


def _by_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        acc += diff * diff
    return acc


def within(a: np.ndarray, b: np.ndarray, eps2: float) -> np.ndarray:
    """True where rows of ``a`` and ``b`` have a squared distance <= eps2."""
    left, _, na = sides(a)
    _, right, nb = sides(b)
    slack = margin_of(na, nb)
    if not np.isfinite(slack):
        return _by_differences(a, b) <= eps2
    return _hits(left @ right.T, eps2, slack, lambda i, j: exact(a[i], b[j]))


def k_nearest(x: np.ndarray, ids: np.ndarray, y: Blocks, other: np.ndarray, k: int, bound: np.ndarray | None = None
              ) -> np.ndarray:
    """The k smallest squared distances of each row of ``x`` to rows of ``y`` with another id (ascending, inf: none).

    ``bound``: squared distances above it need not be found. ``other``: ids in the order of the rows of ``y``.
    """
    best = np.full((len(x), k), np.inf)
    q = Blocks(x, QUERY)
    mine, theirs = ids[q.order], other[y.order]
    limit = np.full(len(x), np.inf) if bound is None else bound[q.order].astype(float)
    slack = margin_of(q.n2, y.n2)
    plain = not (q.finite and y.finite)
    for p, (s, e) in enumerate(q.spans()):
        # row by row: with many measures a piece as a whole is near nearly every other, few of its rows are
        low = np.zeros((e - s, len(y.lo))) if plain else y.least_of(q.x[s:e])
        for i in np.argsort(low.sum(axis=0), kind="stable"):
            ask = np.flatnonzero(low[:, i] <= limit[s:e] + slack) if not plain else np.arange(e - s)
            if not len(ask):
                continue
            t, u = int(y.start[i]), int(y.start[i + 1])
            own = slice(s, e) if len(ask) == e - s else s + ask
            d2 = _by_differences(q.x[own], y.x[t:u]) if plain else q.left[own] @ y.right[t:u].T
            most = limit[own]
            if u - t > 2 * k and not np.isfinite(most).all():
                # no bound yet: the piece's own k + 1 nearest (the row itself may be one) give one
                cut = np.partition(np.where(mine[own, None] == theirs[None, t:u], np.inf, d2), k - 1, axis=1)[:, k - 1]
                most = np.minimum(most, cut + 2 * slack)
            a, b = found(~(d2 > most[:, None]) if plain else d2 <= (most + slack)[:, None])
            a = ask[a]
            keep = mine[s + a] != theirs[t + b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            d = exact(q.x[s + a], y.x[t + b])
            # the candidates of a row beside what it has: the k smallest of both
            rows, at = np.unique(a, return_inverse=True)
            r = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
            v = np.concatenate([d, best[s + rows].reshape(-1)])
            order = np.lexsort((v, r))
            first = np.searchsorted(r[order], np.arange(len(rows)))
            best[s + rows] = v[order][first[:, None] + np.arange(k)]
            limit[s:e] = np.minimum(limit[s:e], best[s:e, -1])
    out = np.empty_like(best)
    out[q.order] = best
    return out


def group_sums(xa: np.ndarray, ga: np.ndarray, xb: np.ndarray, gb: np.ndarray, groups: int, same: bool
               ) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances of each row of ``xa`` to every group of ``xb``, and of each row of ``xb`` to every group of ``xa``.

    ``same``: one block against itself; the first result holds its sums, the second is zero.
    """
    oa, ob = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
    xa, ga, xb, gb = xa[oa], ga[oa], xb[ob], gb[ob]
    sa, sb = np.zeros((len(xa), groups)), np.zeros((len(xb), groups))
    back = sa if same else sb
    left, _, na = sides(xa)
    _, right, nb = sides(xb)
    plain = not (np.isfinite(na).all() and np.isfinite(nb).all())
    # a common limit: rows far out only make more of the small distances exact
    small = SMALL * (na.max(initial=0.0) + nb.max(initial=0.0))
    for t in range(0, len(xb), TILE_B):
        gt = gb[t:t + TILE_B]
        ct = np.flatnonzero(np.append(True, gt[1:] != gt[:-1]))
        for s in range(0, len(xa), TILE_A):
            if same and s >= t + TILE_B:
                break                                   # below the diagonal: done from the other side
            a, b = xa[s:s + TILE_A], xb[t:t + TILE_B]
            if plain:
                d = np.sqrt(_by_differences(a, b))
            else:
                d = left[s:s + TILE_A] @ right[t:t + TILE_B].T
                if d.min() < small:
                    i, j = found(d < small)
                    d[i, j] = exact(a[i], b[j])
                np.sqrt(d, out=d)
            sa[s:s + TILE_A, gt[ct]] += np.add.reduceat(d, ct, axis=1)
            rows = min(len(a), t - s) if same else len(a)      # rows of the tile that lie outside the diagonal square
            if rows > 0:
                gs = ga[s:s + rows]
                cs = np.flatnonzero(np.append(True, gs[1:] != gs[:-1]))
                for u, v in zip(cs, np.append(cs[1:], rows)):
                    back[t:t + TILE_B, gs[u]] += d[u:v].sum(axis=0)
    ra, rb = np.empty_like(sa), np.empty_like(sb)
    ra[oa], rb[ob] = sa, sb
    return ra, rb
