"""Gaussian mixture models (latent profiles) fitted by EM on Spark.

Covariance models follow the eigen-decomposition family
Sigma_k = lambda_k D_k A_k D_k^T (volume, orientation, shape each Equal or
Varying; I = identity).  All fits of a BIC grid advance together: every EM
iteration is ONE pass over the data, where each task evaluates every active
(G, model) fit with numpy and emits only per-component sufficient
statistics (n_k, sum r x, sum r x x^T) and its log-likelihood share.  A log
density is linear in (1, x, x_i x_j), so one product takes the densities of all
components of all fits and another their statistics; a component whose covariance
or scatter would lose digits that way goes by differences from its mean.  Spark
sums those per (fit, component); the driver runs the M-steps on d x d
matrices.  Jobs = iterations of the slowest fit, not fits x iterations.

Starts: the partitions of a model-based agglomeration over micro-clusters
(``agglomerate``), or hard K-means partitions (one sweep over G).  A fit whose
covariance becomes singular (or a component empties) fails: its BIC is
NULL and the grid continues.  BIC = 2 logLik - npar log(n) (larger is better).

Models EVE and VVE (common orientation, varying shapes) have no closed
form: their M-step alternates the diagonal parts with a majorisation-
minimisation update of the common orientation D (minimise
sum_k tr(W_k D B_k D^T) over orthogonal D: linearise at the current D using
W_k <= w_k I, then take the orthogonal Procrustes solution by SVD).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import agglomerate
from cohortlens.operators import kmeans as km
from cohortlens.operators.partials import combine_cells
from cohortlens.schema import GRID_MODELS, ID
from cohortlens.session import ship_package

LOG2PI = math.log(2 * math.pi)
TILE = 512                  # rows whose temporaries stay in the core's cache
WIDE_TILE = 256             # the same beside the components of all fits
WIDE_CELLS = WIDE_TILE << 10    # densities of a tile: fewer components take more rows at a time
LEAST = -600.0              # log of a share that counts as none; shares that are no normal numbers would be slow
OWN_AXES = ("EEV", "VEV")   # models that take the axes of each component from its scatter alone
NARROW = 1e-7               # least variance in any direction, as a share of the rows' mean square, for sums of products


def n_params(model: str, g: int, d: int) -> int:
    """Free parameters: means, mixing proportions and covariance."""
    cov = {
        "EII": 1, "VII": g, "EEI": d, "VEI": g + d - 1, "EVI": 1 + g * (d - 1), "VVI": g * d,
        "EEE": d * (d + 1) // 2, "VEE": g - 1 + d * (d + 1) // 2,
        "EVE": 1 + g * (d - 1) + d * (d - 1) // 2, "VVE": g * d + d * (d - 1) // 2,
        "EEV": d + g * d * (d - 1) // 2, "VEV": g + d - 1 + g * d * (d - 1) // 2,
        "EVV": 1 + g * (d - 1) + g * d * (d - 1) // 2, "VVV": g * d * (d + 1) // 2,
    }[model]
    return g * d + (g - 1) + cov


def _detroot(m: np.ndarray) -> float:
    sign, logdet = np.linalg.slogdet(m)
    if sign <= 0:
        raise np.linalg.LinAlgError("not positive definite")
    return math.exp(logdet / m.shape[0])


def m_step(model: str, nk: np.ndarray, w: np.ndarray, inner: int = 100,
           prev: np.ndarray | None = None) -> np.ndarray:
    """Covariances (G x d x d) from component sizes nk and scatter matrices w.

    ``prev`` (the current covariances) warm-starts the iterative models, so
    each M-step improves on the current parameters (a generalised EM step).
    """
    g, d = w.shape[0], w.shape[1]
    n = nk.sum()
    wt = w.sum(axis=0)
    eye = np.eye(d)
    if model == "EII":
        return np.stack([eye * np.trace(wt) / (n * d)] * g)
    if model == "VII":
        return np.stack([eye * np.trace(w[k]) / (nk[k] * d) for k in range(g)])
    if model == "EEI":
        return np.stack([np.diag(np.diag(wt) / n)] * g)
    if model == "VVI":
        return np.stack([np.diag(np.diag(w[k]) / nk[k]) for k in range(g)])
    if model == "EVI":
        diags = [np.diag(w[k]) for k in range(g)]
        roots = [math.exp(np.log(dk).mean()) for dk in diags]
        lam = sum(roots) / n
        return np.stack([np.diag(lam * diags[k] / roots[k]) for k in range(g)])
    if model == "VEI":
        lam = np.array([np.trace(w[k]) / (nk[k] * d) for k in range(g)])
        for _ in range(inner):
            b = sum(np.diag(w[k]) / lam[k] for k in range(g))
            a = b / math.exp(np.log(b).mean())
            new = np.array([np.sum(np.diag(w[k]) / a) / (nk[k] * d) for k in range(g)])
            if np.max(np.abs(new - lam)) <= 1e-10 * np.max(np.abs(lam)):
                lam = new
                break
            lam = new
        return np.stack([np.diag(lam[k] * a) for k in range(g)])
    if model == "EEE":
        return np.stack([wt / n] * g)
    if model == "VEE":
        lam = np.array([np.trace(w[k]) / (nk[k] * d) for k in range(g)])
        for _ in range(inner):
            c = sum(w[k] / lam[k] for k in range(g))
            c = c / _detroot(c)
            ci = np.linalg.inv(c)
            new = np.array([np.trace(w[k] @ ci) / (nk[k] * d) for k in range(g)])
            done = np.max(np.abs(new - lam)) <= 1e-10 * np.max(np.abs(lam))
            lam = new
            if done:
                break
        return np.stack([lam[k] * c for k in range(g)])
    if model == "EVV":
        roots = [_detroot(w[k]) for k in range(g)]
        lam = sum(roots) / n
        return np.stack([lam * w[k] / roots[k] for k in range(g)])
    if model == "VVV":
        return np.stack([w[k] / nk[k] for k in range(g)])
    if model in ("EVE", "VVE"):
        return _common_orientation(model, nk, w, inner, prev)
    if model in ("EEV", "VEV"):
        vals, vecs = zip(*[np.linalg.eigh(w[k]) for k in range(g)])
        om = [np.clip(v[::-1], 0.0, None) for v in vals]      # descending eigenvalues
        dk = [v[:, ::-1] for v in vecs]
        if model == "EEV":
            s = sum(om)
            a = s / math.exp(np.log(s).mean())
            lam = math.exp(np.log(s).mean()) / n
            return np.stack([lam * dk[k] @ np.diag(a) @ dk[k].T for k in range(g)])
        lam = np.array([np.sum(om[k]) / (nk[k] * d) for k in range(g)])
        for _ in range(inner):
            b = sum(om[k] / lam[k] for k in range(g))
            a = b / math.exp(np.log(b).mean())
            new = np.array([np.sum(om[k] / a) / (nk[k] * d) for k in range(g)])
            done = np.max(np.abs(new - lam)) <= 1e-10 * np.max(np.abs(lam))
            lam = new
            if done:
                break
        return np.stack([lam[k] * dk[k] @ np.diag(a) @ dk[k].T for k in range(g)])
    raise ValueError(f"covariance model {model} not available")


def _common_orientation(model: str, nk: np.ndarray, w: np.ndarray, inner: int,
                        prev: np.ndarray | None = None) -> np.ndarray:
    """Sigma_k = D C_k D^T with C_k diagonal: EVE (C_k = lambda A_k, det A_k = 1)
    or VVE (C_k free).  Alternates C_k given D and an MM step for D."""
    g, d = w.shape[0], w.shape[1]
    n = nk.sum()
    _, dmat = np.linalg.eigh(w.sum(axis=0) if prev is None else prev[0])
    top = np.array([np.linalg.eigvalsh(w[k])[-1] for k in range(g)])

    def diag_parts(dm):
        turned = dm.T @ w                                                  # g x d x d
        proj = np.einsum("kij,ji->ki", turned, dm)                         # g x d
        if np.any(proj <= 0):
            raise np.linalg.LinAlgError("degenerate component")
        if model == "VVE":
            c = proj / nk[:, None]
        else:
            roots = np.exp(np.log(proj).mean(axis=1))
            c = roots.sum() / n * (proj / roots[:, None])
        return turned, c, np.sum(proj / c)

    turned, c, prev = diag_parts(dmat)
    for _ in range(inner):
        b = 1.0 / c
        gmat = np.einsum("ki,kij->ij", b, turned) - (top @ b)[:, None] * dmat.T
        u, _, vt = np.linalg.svd(gmat)
        dmat = -(vt.T @ u.T)
        turned, c, cur = diag_parts(dmat)
        if abs(prev - cur) <= 1e-10 * (1 + abs(cur)):
            break
        prev = cur
    return np.stack([dmat @ np.diag(c[k]) @ dmat.T for k in range(g)])


@dataclass
class Fit:
    model: str
    g: int
    pi: np.ndarray | None = None
    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    loglik: float | None = None
    prev: float | None = None
    iterations: int = 0
    failed: bool = False
    reason: str | None = None
    converged: bool = False
    n: int = 0
    init_centres: np.ndarray | None = None
    history: list = field(default_factory=list)

    def bic(self, d: int) -> float | None:
        if self.failed or self.loglik is None:
            return None
        return 2 * self.loglik - n_params(self.model, self.g, d) * math.log(self.n)


def _prepare(fit: Fit):
    """(log pi, mu, inverse Cholesky, log det) per component."""
    chol_inv, logdet = [], []
    for s in fit.sigma:
        c = np.linalg.cholesky(s)
        chol_inv.append(np.linalg.inv(c))
        logdet.append(2 * np.log(np.diag(c)).sum())
    return np.log(fit.pi), fit.mu, np.stack(chol_inv), np.array(logdet)


def _log_density(x, lp, mu, li, ld):
    n, d = x.shape
    g = len(lp)
    # the whitened differences of all components from one product: (x, 1) times (li^T; -mu li^T)
    turn = np.concatenate([li.transpose(2, 0, 1).reshape(d, g * d), -np.einsum("kij,kj->ki", li, mu).reshape(1, g * d)])
    z = (np.hstack([x, np.ones((n, 1))]) @ turn).reshape(n, g, d)
    return lp - 0.5 * (d * LOG2PI + ld + np.einsum("nkd,nkd->nk", z, z))


def _shares(logp: np.ndarray) -> np.ndarray:
    """The log densities (.. x components x rows) become responsibilities in place; the rows' log likelihoods."""
    top = logp.max(axis=-2)
    logp -= top[..., None, :]
    np.maximum(logp, LEAST, out=logp)
    np.exp(logp, out=logp)
    whole = logp.sum(axis=-2)
    logp *= (1 / whole)[..., None, :]
    return top + np.log(whole)


def _responsibilities(x, state):
    kind, payload = state
    if kind == "parts":
        lab = payload.group[np.argmin(km._sqdist(x, payload.centres), axis=1)]
        r = np.zeros((x.shape[0], len(payload.means)))
        r[np.arange(x.shape[0]), lab] = 1.0
        return r, 0.0
    if kind == "hard":
        d2 = km._sqdist(x, payload)
        lab = np.argmin(d2, axis=1)
        r = np.zeros((x.shape[0], payload.shape[0]))
        r[np.arange(x.shape[0]), lab] = 1.0
        return r, 0.0
    logp = _log_density(x, *payload)
    m = logp.max(axis=1, keepdims=True)
    lse = m[:, 0] + np.log(np.exp(logp - m).sum(axis=1))
    return np.exp(logp - lse[:, None]), float(lse.sum())


def _scatter(x, shift, r):
    """g x d x d: sum of r (x - shift)(x - shift)^T for each component."""
    return _scatter_of(np.ascontiguousarray(x.T), shift, np.ascontiguousarray(r.T))


def _scatter_of(xt, shift, r):
    """The same with a column for each row of the table: ``xt`` d x rows, ``r`` g x rows."""
    out = np.empty((len(shift), len(xt), len(xt)))
    y, yr = np.empty(xt.shape), np.empty(xt.shape)
    for k in range(len(shift)):
        np.subtract(xt, shift[k][:, None], out=y)
        np.multiply(y, r[k], out=yr)
        np.matmul(yr, y.T, out=out[k])
    return out


def _products(x):
    """(1, x, x_i x_j for i <= j), a column for each row of ``x``."""
    i, j = np.triu_indices(x.shape[1])
    xt = np.ascontiguousarray(x.T)
    return np.vstack([np.ones((1, len(x))), xt, xt[i] * xt[j]])


def _weights(payload):
    """g x products: what ``_products`` is multiplied by for the log densities of the components."""
    lp, mu, li, ld = payload
    d = mu.shape[1]
    prec = np.einsum("kji,kjl->kil", li, li)
    turned = np.einsum("kij,kj->ki", prec, mu)
    i, j = np.triu_indices(d)
    const = lp - 0.5 * (d * LOG2PI + ld + (turned * mu).sum(axis=1))
    return np.hstack([const[:, None], turned, -0.5 * prec[:, i, j] * np.where(i == j, 1.0, 2.0)])


def _turns(payload, which):
    """(what (1, x) is multiplied by for the whitened differences of some components, the rest of their log densities)."""
    lp, mu, li, ld = (a[which] for a in payload)
    d = mu.shape[1]
    turn = np.concatenate([-np.einsum("kij,kj->ki", li, mu)[:, :, None], li], axis=2)
    return turn.reshape(-1, d + 1), lp - 0.5 * (d * LOG2PI + ld)


def _wide_sums(x, weights, sizes, room=None, close=None, flat=()):
    """(sum of responsibility x products of every component, log likelihood of every fit) by two products for all fits.

    ``sizes``: [(fits, components of each)], as the rows of ``weights`` follow each other. ``close``: (rows, ``_turns``) of
    components whose density is taken by differences. ``flat``: [(rows, means)] of those whose scatter around the means is;
    these follow. ``room``: place for the densities.
    """
    d = x.shape[1]
    q = _products(x)
    r = np.empty(len(weights) * len(x)) if room is None else room[:len(weights) * len(x)]
    r = np.matmul(weights, q, out=r.reshape(len(weights), len(x)))
    if close is not None:
        rows, turn, rest = close
        z = (turn @ q[:d + 1]).reshape(len(rows), d, -1)
        np.multiply(z, z, out=z)
        r[rows] = rest[:, None] - 0.5 * z.sum(axis=1)
    lls, at = [], 0
    for fits, g in sizes:
        lls.append(_shares(r[at:at + fits * g].reshape(fits, g, -1)).sum(axis=1))
        at += fits * g
    return r @ q.T, np.concatenate(lls), *[_scatter_of(q[1:d + 1], mu, r[at]) for at, mu in flat]


def _estep(cols, states, careful=frozenset(), flat={}):
    """A task's frames, or rows x measures arrays, -> a frame of the sums of all fits.

    ``careful``: fit -> components that go by differences (fits alone: all of theirs), ``flat``: those whose scatter does.
    """
    d = len(cols)
    careful = {f: sorted(careful[f] if isinstance(careful, dict) else range(len(_shift(states[f])))) for f in careful if f in states}
    flat = {f: sorted({*flat.get(f, ()), *careful.get(f, ())}) for f in {*flat, *careful} if f in states}
    # fits of one start share its very state: it is summed once
    shared = {f: min(o for o in states if states[o][1] is state[1]) for f, state in states.items()}
    by_size: dict[int, list] = {}
    for f, (kind, payload) in states.items():
        if kind == "soft" and f == shared[f]:
            by_size.setdefault(len(payload[0]), []).append(f)
    wide = [f for g in sorted(by_size) for f in by_size[g]]
    sizes = [(len(by_size[g]), g) for g in sorted(by_size)]
    weights = np.vstack([_weights(states[f][1]) for f in wide]) if wide else None
    firsts = dict(zip(wide, np.cumsum([0] + [len(_shift(states[f])) for f in wide]).tolist()))
    exact = {f: (firsts[f] + np.array(flat[f]), _shift(states[f])[flat[f]]) for f in wide if f in flat}
    turns = [(firsts[f] + np.array(careful[f]), *_turns(states[f][1], careful[f])) for f in wide if f in careful]
    close = tuple(map(np.concatenate, zip(*turns))) if turns else None
    single = sorted(set(shared.values()) - set(wide))
    step = max(WIDE_TILE, WIDE_CELLS // len(weights)) if wide else 0

    def fn(it):
        total: dict[int, list] = {}
        sums = None
        room = np.empty(step * len(weights)) if wide else None
        for rows in it:
            every = rows[cols].to_numpy(dtype=float) if isinstance(rows, pd.DataFrame) else rows
            for at in range(0, len(every), step) if wide else ():
                got = _wide_sums(every[at:at + step], weights, sizes, room, close, exact.values())
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
            for at in range(0, len(every), TILE) if single else ():
                x = every[at:at + TILE]
                for fid in single:
                    state = states[fid]
                    r, ll = _responsibilities(x, state)
                    stats = [r.sum(axis=0), ll, r.T @ x, _scatter(x, _shift(state), r)]
                    if fid in total:
                        for i, v in enumerate(stats):
                            total[fid][i] = total[fid][i] + v
                    else:
                        total[fid] = stats
        if sums is not None:
            i, j = np.triu_indices(d)
            differences = dict(zip(exact, sums[2:]))
            for fid, ll in zip(wide, sums[1]):
                mu = _shift(states[fid])
                got = sums[0][firsts[fid]:firsts[fid] + len(mu)]
                nk, sx, sxx = got[:, 0], got[:, 1:d + 1], np.empty((len(mu), d, d))
                sxx[:, i, j] = sxx[:, j, i] = got[:, d + 1:]
                # the scatter around the previous means, as the other fits have it
                cross = np.einsum("ki,kj->kij", mu, sx)
                w = sxx - cross - cross.transpose(0, 2, 1) + nk[:, None, None] * np.einsum("ki,kj->kij", mu, mu)
                if fid in differences:
                    w[flat[fid]] = differences[fid]
                total[fid] = [nk, ll, sx, w]
        # one frame of all fits: pandas would spend longer on gluing many wide ones
        blocks = []
        for fid, first in shared.items():
            if first in total:
                nk, ll, sx, sxx = total[first]
                g = len(nk)
                blocks.append(np.hstack([np.full((g, 1), fid), np.arange(g)[:, None], nk[:, None], np.where(np.arange(g) == 0, ll, 0.0)[:, None],
                                         sx, sxx.reshape(g, d * d)]))
        if blocks:
            out = pd.DataFrame(np.vstack(blocks), columns=["fit", "k", "nk", "ll"] + [f"s{j}" for j in range(d)] + [f"q{j}" for j in range(d * d)])
            yield out.astype({"fit": "int32", "k": "int32"})
    return fn


def _shift(state) -> np.ndarray:
    """Scatter is summed around these points (the previous means), which keeps it from cancelling."""
    kind, payload = state
    return payload if kind == "hard" else payload.means if kind == "parts" else payload[1]


def _pass(df, cols, states, careful=frozenset(), flat={}) -> dict[int, tuple]:
    """fit -> (nk, log likelihood, sums, scatter around the previous means) over all rows."""
    d = len(cols)
    i, j = np.triu_indices(d)
    sums = _estep(cols, states, careful, flat)
    width = 2 + d + len(i)

    def fn(it):
        for frame in sums(it):
            # every task has the same fits and components in the same order; the scatter is symmetric
            cells = frame.to_numpy(float)[:, np.r_[2:4 + d, 4 + d + i * d + j]].reshape(-1)
            yield pd.DataFrame({"cell": np.arange(len(cells), dtype=np.int32), "v": cells})

    sizes = {f: len(_shift(state)) for f, state in states.items()}
    cells = combine_cells(km.map_arrays(df, cols, fn, "cell int, v double"), sum(sizes.values()) * width).reshape(-1, width)
    out, at = {}, 0
    for f, g in sizes.items():
        got = cells[at:at + g]
        w = np.empty((g, d, d))
        w[:, i, j] = w[:, j, i] = got[:, 2 + d:]
        out[f] = got[:, 0], float(got[:, 1].sum()), got[:, 2:2 + d], w
        at += g
    return out


def _moments(sums: tuple, state):
    """(nk, means, scatter matrices) of a fit's components from the sums of a pass."""
    nk, _, sx, sxx = sums
    if np.any(nk <= 1e-8):
        return nk, None, None
    mu = sx / nk[:, None]
    off = mu - _shift(state)
    w = sxx - nk[:, None, None] * np.einsum("ki,kj->kij", off, off)
    return nk, mu, (w + np.transpose(w, (0, 2, 1))) / 2


def _narrow(cov: np.ndarray, nk: np.ndarray, mu: np.ndarray, w: np.ndarray) -> bool:
    """Whether a covariance matrix is so narrow in some direction that sums of products lose digits (or is no number)."""
    return len(_narrow_ones(cov, nk, mu, w)) > 0


def _narrow_ones(cov: np.ndarray, nk: np.ndarray, mu: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The components whose covariance matrix is (all, if one is no number)."""
    if not (np.all(np.isfinite(cov)) and np.all(np.isfinite(w))):
        return np.arange(len(cov))
    scale = (np.einsum("kii->", w) + (nk * (mu * mu).sum(axis=1)).sum()) / (nk.sum() * mu.shape[1])
    return np.flatnonzero(~(np.linalg.eigvalsh(cov).min(axis=1) >= NARROW * scale))


def fit_grid(df: DataFrame, cols: Sequence[str], groups: Sequence[int], models: Sequence[str] = GRID_MODELS,
             tol: float = 1e-5, seed: int = 123, max_iter: int | None = None, start: str = "kmeans", key: str = ID
             ) -> dict[tuple[int, str], Fit]:
    """EM for every (G, model) pair until the likelihood settles; fits keyed by (G, model).

    ``start``: "agglomerative" (one merge tree for all G) or "kmeans".

    EM never lowers the likelihood, so every fit ends by ``tol`` or fails with
    a ``reason``. With ``max_iter`` a fit may stop before; it then is not
    ``converged`` and its reason says so.
    """
    cols = list(cols)
    d = len(cols)
    rows = km.spread_rows(df, cols)
    if start == "agglomerative":
        parts = agglomerate.partitions(df, cols, list(groups), seed=seed, key=key)
        first = {g: ("parts", p) for g, p in parts.items()}
    else:
        starts = km.sweep(df, cols, list(groups), nstart=1, max_iter=20, seed=seed)
        first = {g: ("hard", starts.best(g).centres) for g in groups}
    fits: dict[int, Fit] = {}
    keys: dict[int, tuple[int, str]] = {}
    fid = 0
    for g in groups:
        for m in models:
            fits[fid] = Fit(model=m, g=g, init_centres=first[g][1] if first[g][0] == "hard" else first[g][1].means)
            keys[fid] = (g, m)
            fid += 1
    states = {f: first[fit.g] for f, fit in fits.items()}
    narrow: dict[int, frozenset] = {}   # fit -> components that go by differences
    flat: dict[int, frozenset] = {}     # those whose scatter does
    while states:
        stats = _pass(rows, cols, states, narrow, flat)
        steps = {f: _step(fits[f], stats[f], state) for f, state in states.items() if not _settled(fits[f], stats[f], state, tol)}
        # a fit whose sums of products may have lost digits is summed once more, by differences
        again = {}
        for f, step in steps.items():
            if states[f][0] == "soft" and _more(narrow, f, step.lost) | _more(flat, f, step.flat):
                again[f] = states[f]
        if again:
            stats |= _pass(rows, cols, again, narrow, flat)
            steps |= {f: _step(fits[f], stats[f], state) for f, state in again.items()}
        nxt = {}
        for f, state in states.items():
            fit, ll = fits[f], stats[f][1]
            if state[0] == "soft":
                if not math.isfinite(ll):
                    fit.failed, fit.reason = True, "likelihood not finite"
                    continue
                settled = _settled(fit, stats[f], state, tol)
                fit.prev, fit.loglik = fit.loglik, ll
                fit.history.append(fit.loglik)
                if settled:
                    fit.converged = True
                    continue
                if max_iter is not None and fit.iterations > max_iter:
                    fit.reason = "iteration limit"
                    continue
            step = steps[f]
            if step.mu is not None:
                fit.n = int(round(step.nk.sum()))
            if step.reason:
                fit.failed, fit.reason = True, step.reason
                continue
            fit.pi, fit.mu, fit.sigma = step.nk / step.nk.sum(), step.mu, step.sigma
            nxt[f] = ("soft", step.payload)
            _more(narrow, f, step.lost)
            fit.iterations += 1
        states = nxt
    return {keys[f]: fit for f, fit in fits.items()}


def _more(known: dict[int, frozenset], f: int, found: frozenset) -> bool:
    """Whether there are new components among those found; they are known from now on."""
    new = not found <= known.get(f, frozenset())
    if new:
        known[f] = known.get(f, frozenset()) | found
    return new


def _settled(fit: Fit, sums: tuple, state, tol: float) -> bool:
    return state[0] == "soft" and fit.loglik is not None and abs(sums[1] - fit.loglik) <= tol * (1 + abs(sums[1]))


@dataclass
class _Step:
    """A fit's M-step: what the next pass needs, or the ``reason`` why there is none.

    ``lost``: components whose sums of products may have lost digits that the step needs; ``flat``: those with a narrow scatter.
    """

    nk: np.ndarray
    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    payload: tuple | None = None
    reason: str | None = None
    lost: frozenset = frozenset()
    flat: frozenset = frozenset()


def _step(fit: Fit, sums: tuple, state) -> _Step:
    nk, mu, w = _moments(sums, state)
    if w is None:
        return _Step(nk, reason="empty component")
    every = frozenset(range(len(nk)))
    step = _Step(nk, mu, lost=frozenset() if np.all(np.isfinite(nk)) else every)
    try:
        if fit.model in OWN_AXES:
            step.flat = frozenset(_narrow_ones(w / nk[:, None, None], nk, mu, w).tolist())
        with np.errstate(divide="raise", invalid="raise", over="raise"):
            step.sigma = m_step(fit.model, nk, w, prev=fit.sigma)
        if not np.all(np.isfinite(step.sigma)):
            raise FloatingPointError("non-finite covariance")
        step.payload = _prepare(Fit(fit.model, fit.g, nk / nk.sum(), mu, step.sigma))
        step.lost |= frozenset(_narrow_ones(step.sigma, nk, mu, w).tolist())
    except (np.linalg.LinAlgError, ValueError, FloatingPointError, ZeroDivisionError, OverflowError) as e:
        step.reason, step.lost = str(e)[:80] or type(e).__name__, every
    return step


def _classify(cols, params, key, keep=False):
    def fn(it):
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=float)
            logp = _log_density(x, *params)
            m = logp.max(axis=1, keepdims=True)
            lse = m[:, 0] + np.log(np.exp(logp - m).sum(axis=1))
            r = np.exp(logp - lse[:, None])
            lab = np.argmax(r, axis=1)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "cluster": (lab + 1).astype("int64"),
                                "uncertainty": 1.0 - r[np.arange(len(x)), lab],
                                "log_map": np.log(np.clip(r[np.arange(len(x)), lab], 1e-300, None))}
                               | ({c: pdf[c] for c in cols} if keep else {}))
    return fn


def classify(df: DataFrame, cols: Sequence[str], fit: Fit, key: str = ID, keep: bool = False) -> DataFrame:
    """(key, cluster, uncertainty, log_map): MAP component (1-based) per row; ``keep``: the measures, too."""
    if fit.failed or fit.sigma is None:
        raise ValueError(f"{fit.model} with G={fit.g} did not fit (singular covariance)")
    ship_package(df.sparkSession)
    params = _prepare(fit)
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        _classify(list(cols), params, key, keep), f"{key} bigint, cluster bigint, uncertainty double, log_map double"
        + ("".join(f", {c} double" for c in cols) if keep else ""))


def responsibilities(df: DataFrame, cols: Sequence[str], fit: Fit, key: str = ID) -> DataFrame:
    """(key, cluster, probability): each row's share of every component (1-based); they add up to 1."""
    if fit.failed or fit.sigma is None:
        raise ValueError(f"{fit.model} with G={fit.g} did not fit (singular covariance)")
    ship_package(df.sparkSession)
    cols, params = list(cols), _prepare(fit)

    def fn(it):
        for pdf in it:
            r, _ = _responsibilities(pdf[cols].to_numpy(dtype=float), ("soft", params))
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), fit.g), "cluster": np.tile(np.arange(1, fit.g + 1), len(r)),
                                "probability": r.reshape(-1)})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        fn, f"{key} bigint, cluster bigint, probability double")
