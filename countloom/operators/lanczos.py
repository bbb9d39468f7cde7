"""Spectra of X'X from products with few vectors alone: the density of all eigenvalues, and the leading ones with bounds.

Nothing here knows how X is stored: ``product`` takes a block of vectors (d x b) to X'X times it, a pass over the rows. The driver holds
blocks of vectors of the small axis, never the matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
_TINY = 1e-300
#: Largest residual, as a share of the bound, of the value that follows those above it.
SETTLED = 0.02


class Subspace:
    """A growing subspace and its image; its Ritz pairs come with their residuals |A v - value v|.

    It grows by the residuals of its leading unfinished pairs, orthogonalised in full; when it gets wide it begins anew from its
    leading half, so nothing is computed again. ``room``: the most bytes that it may hold.
    """

    def __init__(self, product: Product, d: int, *, block: int = 12, width: int = 96, seed: int = 42, room: int = 256 << 20):
        self.product, self.d, self.block, self.width = product, d, min(block, d), width
        self.most = room // (16 * d)
        self.rng = np.random.default_rng(seed)
        if self.most < min(d, 3 * self.block):
            raise ValueError(f"{3 * self.block} vectors of {d} entries and their images take more than {room} bytes")
        self.basis = np.linalg.qr(self.rng.normal(size=(d, self.block)))[0]
        self.image = product(self.basis)
        self.passes = 1

    @property
    def whole(self) -> bool:
        return self.basis.shape[1] == self.d

    def ritz(self) -> tuple[np.ndarray, np.ndarray]:
        """Values (descending) and their coordinates."""
        small = self.basis.T @ self.image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        return value[::-1], vector[:, ::-1]

    def pairs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, vectors, residual vectors) of the ``n`` leading pairs."""
        value, vector = self.ritz()
        v = self.basis @ vector[:, :n]
        return value[:n], v, self.image @ vector[:, :n] - v * value[:n]

    def grow(self, want: int, tol: float) -> None:
        """A pass: by the residuals of the first unfinished of ``want`` pairs and those behind them."""
        value, v, rest = self.pairs(max(want + 1, self.block))
        size = np.linalg.norm(rest, axis=0)
        some = np.flatnonzero(size > tol * max(abs(value[0]), _TINY))[: self.block]
        fresh = np.hstack([rest[:, some] / size[some], self.rng.normal(size=(self.d, self.block - len(some)))])
        limit = min(max(self.width, 2 * want + 2 * self.block), self.most)
        if self.basis.shape[1] + self.block > limit and self.basis.shape[1] < self.d:
            keep = min(self.basis.shape[1], max(limit // 2, want + self.block))
            if keep + self.block > self.most:
                raise ValueError(f"{want} components of {self.d} entries, their vectors and images take too many bytes")
            vector = self.ritz()[1][:, :keep]
            self.basis, self.image = self.basis @ vector, self.image @ vector
        for _ in range(2):
            fresh -= self.basis @ (self.basis.T @ fresh)
            fresh = np.linalg.qr(fresh)[0]
        fresh = fresh[:, : self.d - self.basis.shape[1]]
        self.basis, self.image = np.hstack([self.basis, fresh]), np.hstack([self.image, self.product(fresh)])
        self.passes += 1


@dataclass
class Density:
    """The distribution of eigenvalues: chains of sorted points with weights that add up to one, and values known apart."""

    chains: list[tuple[np.ndarray, np.ndarray]]
    known: np.ndarray
    d: int

    def __post_init__(self):
        self.points = np.unique(np.concatenate([*(p for p, _ in self.chains), self.known]))
        # a point of a quadrature stands for the middle of its weight
        inner = np.mean([np.interp(self.points, p, np.cumsum(w) - w / 2, left=0.0, right=1.0) for p, w in self.chains], axis=0) if self.chains else 0.0
        known = np.sort(self.known)
        below = (np.searchsorted(known, self.points) + np.searchsorted(known, self.points, "right")) / 2
        self.cumulative = (1 - len(known) / self.d) * inner + below / self.d

    def quantile(self, q: float) -> float:
        return float(np.interp(q, self.cumulative, self.points))

    def distance(self, cdf: Callable[[np.ndarray], np.ndarray]) -> float:
        """The largest distance from a distribution function, at the points."""
        return float(np.abs(self.cumulative - cdf(self.points)).max())


def density(product: Product, d: int, *, known: np.ndarray | None = None, vectors: np.ndarray | None = None, chains: int = 8, steps: int = 32, seed: int = 42) -> Density:
    """Stochastic Lanczos quadrature: ``steps`` passes with ``chains`` random starts.

    ``known`` eigenvalues, with their ``vectors``, are taken out first: values far from the others would cost steps. The error of the distribution
    function falls as 1 / sqrt(chains d) and as 1 / steps.
    """
    rng = np.random.default_rng(seed)
    known = np.empty(0) if known is None else known
    if len(known) == d:
        return Density([], known, d)
    out = (lambda x: x - vectors @ (vectors.T @ x)) if len(known) else (lambda x: x)
    now = out(rng.choice([-1.0, 1.0], (d, chains)))
    now /= np.linalg.norm(now, axis=0)
    before, beta = np.zeros_like(now), np.zeros(chains)
    diagonal, beside = [], []
    for _ in range(min(steps, d - len(known))):
        new = out(product(now)) - before * beta
        alpha = (now * new).sum(0)
        new -= now * alpha
        diagonal.append(alpha)
        beta = np.linalg.norm(new, axis=0)
        beta = np.where(beta > 1e-10 * max(np.abs(alpha).max(), _TINY), beta, 0.0)
        beside.append(beta)
        before, now = now, np.divide(new, beta, out=np.zeros_like(new), where=beta > 0)
    found = []
    for a, b in zip(np.array(diagonal).T, np.array(beside).T):
        n = int(np.flatnonzero(b == 0)[0]) + 1 if (b == 0).any() else len(a)  # the chain ends with its invariant subspace
        value, vector = np.linalg.eigh(np.diag(a[:n]) + np.diag(b[: n - 1], 1) + np.diag(b[: n - 1], -1))
        found.append((value, vector[0] ** 2))
    return Density(found, known, d)


@dataclass
class Leading:
    """Leading eigenvalues (descending), their vectors and residuals; and the value that follows them (0: none)."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    following: float


def outliers(space: Subspace, *, passes: int = 8, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the leading pairs that a few passes finish: those far above the others."""
    for _ in range(passes):
        if not space.whole:
            space.grow(space.block, tol / 10)
    value, v, rest = space.pairs(space.basis.shape[1])
    done = np.linalg.norm(rest, axis=0) <= tol * np.maximum(value, _TINY)
    n = len(done) if done.all() else int(done.argmin())
    return value[:n], v[:, :n]


def leading(space: Subspace, *, k: int | None = None, above: float | None = None, tol: float = 1e-7, passes: int = 400) -> Leading:
    """The ``k`` leading eigenpairs of a positive semidefinite operator, or all whose value exceeds ``above``.

    A pair is finished when its residual is at most ``tol`` times the largest value. With ``above``, the first value that is not above it has to
    be settled too: its residual must be small (``SETTLED``) and less than its distance from ``above``. Raises
    if the passes do not suffice: values too close to ``above`` are not counted by chance.
    """
    for _ in range(passes):
        value = space.ritz()[0]
        want = k if k is not None else int((value > above).sum())
        if not space.whole and want < len(value):
            top, v, rest = space.pairs(want + 1)
            size = np.linalg.norm(rest, axis=0)
            if not (size[:want] > tol * max(top[0], _TINY)).any():
                if above is None or size[want] < min(SETTLED * above, above - top[want]):
                    return Leading(top[:want], v[:, :want], size[:want], float(top[want]))
        elif space.whole:
            if want > len(value):
                raise ValueError(f"there are only {len(value)} values")
            top, v, rest = space.pairs(want)
            return Leading(top, v, np.linalg.norm(rest, axis=0), float(value[want]) if want < len(value) else 0.0)
        space.grow(want, tol)
    raise RuntimeError(f"not settled after {space.passes} passes: {want} values")
