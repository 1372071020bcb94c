"""Row-local updates of masked factorisations, on blocks of observed cells. Plain numpy; nothing here knows Spark.

A block holds some rows of the observed cells in row-major order. Each update reads the other factor and returns
new values of its own rows, or sums over its cells. Columns are the rows of the transposed block.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from ..functions.special import RowDraws, tn_draw, tn_moments


#: Cells over which sums are taken at once; what is made for each cell is held for so many.
PART_CELLS = 1 << 18


def in_parts(fn):
    """A function of sums over a block's cells, taken over parts of a large block and added up."""

    @functools.wraps(fn)
    def run(block, *shared):
        if len(block.val) <= PART_CELLS:
            return fn(block, *shared)
        out = None
        for part in block.parts():
            value = fn(part, *shared)
            out = value if out is None else {k: out[k] + value[k] for k in out} if isinstance(out, dict) else out + value
        return out

    return run


class Block:
    """Rows ids[0], ids[1], ... with their cells: idx (column), val, and row (position among ids) of each.

    at: where the rows stand in their own factor (their ids, unless only a part of it is here). test: a block of the same
    rows whose cells are judged and not trained on."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, idx: np.ndarray, val: np.ndarray, at: np.ndarray | None = None, test: Block | None = None):
        self.ids, self.idx, self.val = ids, idx, val
        self.at, self.test = ids if at is None else at, test
        self.ptr = np.concatenate(([0], np.cumsum(counts)))
        self.row = np.repeat(np.arange(len(ids)), counts)

    @classmethod
    def of(cls, i: np.ndarray, j: np.ndarray, r: np.ndarray, n: int) -> Block:
        order = np.lexsort((j, i))
        return cls(np.arange(n), np.bincount(i, minlength=n), j[order], r[order])

    @classmethod
    def parted(cls, ids: np.ndarray, counts: np.ndarray, idx: np.ndarray, val: np.ndarray, tested: np.ndarray | None, at: np.ndarray | None = None) -> Block:
        """All cells; or, given which of them are tested, the others with those beside them."""
        if tested is None:
            return cls(ids, counts, idx, val, at)
        row = np.repeat(np.arange(len(ids)), counts)
        test, train = (cls(ids, np.bincount(row[x], minlength=len(ids)), idx[x], val[x], at) for x in (tested, ~tested))
        train.test = test
        return train

    def parts(self):
        """Blocks of the same rows that hold PART_CELLS of the cells each."""
        for at in range(0, len(self.val), PART_CELLS):
            row = self.row[at : at + PART_CELLS]
            yield Block(self.ids, np.bincount(row, minlength=len(self.ids)), self.idx[at : at + PART_CELLS], self.val[at : at + PART_CELLS], self.at)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over each row's cells of values given by cell (cells, or cells x k)."""
        if x.ndim == 1:
            return np.bincount(self.row, x, len(self.ids))
        return np.stack([np.bincount(self.row, x[:, k], len(self.ids)) for k in range(x.shape[1])], 1)

    def gram(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: the sum of h_j h_j' over its cells, and of r h_j."""
        k = h.shape[1]
        g, b = np.empty((len(self.ids), k, k)), np.empty((len(self.ids), k))
        if len(self.val) < 16 * k * len(self.ids) and k <= 8:  # many short rows: no loop over them
            own = h[self.idx]
            for x in range(k):
                b[:, x] = self.sums(self.val * own[:, x])
                for y in range(x, k):
                    g[:, x, y] = g[:, y, x] = self.sums(own[:, x] * own[:, y])
            return g, b
        for n, (x, y) in enumerate(zip(self.ptr, self.ptr[1:])):
            own = h[self.idx[x:y]]
            g[n], b[n] = own.T @ own, self.val[x:y] @ own
        return g, b

    def products(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The prediction of each cell."""
        return np.einsum("ck,ck->c", own[self.at][self.row], other[self.idx])


def scan(x: np.ndarray, cross: np.ndarray, diagonal: np.ndarray, b: np.ndarray, rate: np.ndarray, tau: float, choose) -> None:
    """Gauss-Seidel over the factors k: precision and mean of each row's conditional, then choose(mu, precision, k) is written."""
    for k in range(x.shape[1]):
        precision = tau * diagonal[:, k]
        others = np.einsum("nk,nk->n", cross[:, k], x) - cross[:, k, k] * x[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            mu = (tau * (b[:, k] - others) - rate[:, k]) / precision
        x[:, k] = choose(mu, precision, k)


# --- updates of the rows of one side: own factor given the other ---------------------------------------------------


def multiplicative(block: Block, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sweep that lowers the I-divergence; IEEE rules where a prediction or a sum is zero."""
    x = own[block.at].copy()
    with np.errstate(all="ignore"):
        p = np.einsum("ck,ck->c", x[block.row], other[block.idx])
        for k in range(x.shape[1]):
            h = other[block.idx, k]
            new = x[:, k] * block.sums(h * block.val / p) / block.sums(h)
            p = p + (new - x[:, k])[block.row] * h
            x[:, k] = new
    return x


@in_parts
def multiplied(block: Block, own: np.ndarray, other: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """What the sweep needs of factor k, for rows whose cells are in several blocks."""
    with np.errstate(all="ignore"):
        h = other[block.idx, k]
        return {"top": block.sums(h * block.val / block.products(own, other)), "low": block.sums(h)}


def most_likely(block: Block, own, other, rate, tau: float, least: float) -> np.ndarray:
    """Conditional modes, at least `least`; a factor without weight in a row keeps its value."""
    return modes(*block.gram(other), own[block.at], rate[block.at], tau, least)


def modes(g: np.ndarray, b: np.ndarray, own, rate, tau: float, least: float) -> np.ndarray:
    """Of rows whose sums are these."""
    x = own.copy()

    def choose(mu, precision, k):
        return np.where(precision > 0, np.maximum(np.maximum(mu, 0.0), least), x[:, k])

    scan(x, g, np.einsum("nkk->nk", g), b, rate, tau, choose)
    return x


def drawn(block: Block, own, other, rate, tau: float, key: tuple[int, ...]) -> np.ndarray:
    """Draws from the conditionals. Numbers depend on the key and the row only, however rows fall into blocks."""
    return draws(*block.gram(other), block.ids, own[block.at], rate[block.at], tau, key)


def draws(g: np.ndarray, b: np.ndarray, ids: np.ndarray, own, rate, tau: float, key: tuple[int, ...]) -> np.ndarray:
    """For rows whose sums are these."""
    x, rng = own.copy(), RowDraws(key, ids)

    def choose(mu, precision, k):
        rng.begin(k)
        return tn_draw(mu, precision, rng)

    scan(x, g, np.einsum("nkk->nk", g), b, rate, tau, choose)
    return x


def variational(block: Block, own: np.ndarray, other, other_var, rate, tau: float, middle=None, middle_var=None, order=None):
    """Means, variances, mu and precision of the rows' factors. With middle (k x l), the other side's l factors are
    seen through it, and its variance and theirs enter the precision and the coupling of factors."""
    return expected(variational_sums(block, other, other_var, middle), own[block.at], rate[block.at], tau, middle, middle_var, order)


def variational_sums(block: Block, other, other_var, middle=None) -> dict[str, np.ndarray]:
    g, b = block.gram(other if middle is None else other @ middle.T)
    out = {"g": g, "b": b, "spread": block.sums(other_var[block.idx])}
    return out if middle is None else out | {"square": block.sums(other[block.idx] ** 2)}


def expected(sums: dict, own: np.ndarray, lam, tau: float, middle=None, middle_var=None, order=None) -> np.ndarray:
    """Of rows whose sums are these."""
    x = own.copy()
    out = [np.empty_like(x) for _ in range(4)]
    g, b, spread = sums["g"], sums["b"], sums["spread"]
    if middle is None:
        cross, diagonal = g, np.einsum("nkk->nk", g) + spread
    else:
        square = sums["square"]
        cross = g + np.einsum("kl,ml,nl->nkm", middle, middle, spread)
        extra = (spread + square) @ (middle_var + middle**2).T - square @ (middle**2).T
        diagonal = np.einsum("nkk->nk", g) + extra
    for k in order if order is not None else range(x.shape[1]):
        precision = tau * diagonal[:, k]
        others = np.einsum("nk,nk->n", cross[:, k], x) - cross[:, k, k] * x[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            mu = (tau * (b[:, k] - others) - lam[:, k]) / precision
        mean, var = tn_moments(mu, precision)
        x[:, k] = mean
        for o, v in zip(out, (mean, var, mu, precision)):
            o[:, k] = v
    return np.stack(out, 2)


# --- sums over all cells -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Of pairs of a truth r and a prediction p: their number, means, centred sums of squares and products, the squared
    error and the I-divergence, by name or place. Added together, they are those of all pairs; no large sums are
    subtracted."""

    n: float
    mean_r: float
    mean_p: float
    rr: float
    pp: float
    rp: float
    se: float
    div: float

    def __getitem__(self, place: int) -> float:
        return (self.n, self.mean_r, self.mean_p, self.rr, self.pp, self.rp, self.se, self.div)[place]

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        share, dr, dp = other.n / n, other.mean_r - self.mean_r, other.mean_p - self.mean_p
        w = self.n * share
        return Moments(n, self.mean_r + share * dr, self.mean_p + share * dp, self.rr + other.rr + w * dr * dr, self.pp + other.pp + w * dp * dp, self.rp + other.rp + w * dr * dp, self.se + other.se, self.div + other.div)


def cell_sums(r: np.ndarray, p: np.ndarray) -> Moments:
    """Moments of these cells; the divergence of a cell of r = 0 is its prediction."""
    if not len(r):
        return Moments(*[0.0] * 8)
    with np.errstate(all="ignore"):
        div = np.where(r > 0, r * np.log(np.where(r > 0, r, 1.0) / p) - r + p, p)
        mean_r, mean_p = float(r.mean()), float(p.mean())
        dr, dp = r - mean_r, p - mean_p
        return Moments(float(len(r)), mean_r, mean_p, float((dr * dr).sum()), float((dp * dp).sum()), float((dr * dp).sum()), float(((r - p) ** 2).sum()), float(div.sum()))


@in_parts
def fit_sums(block: Block, own, other) -> Moments:
    return cell_sums(block.val, block.products(own, other))


def fit_both(block: Block, own, other) -> dict[str, Moments]:
    """The sums of the training cells, and those of the test cells where there are any beside them."""
    out = {"train": fit_sums(block, own, other)}
    return out if block.test is None else out | {"test": fit_sums(block.test, own, other)}


def middle_sums(block: Block, f, g, f_var=None, g_var=None):
    """What the update of the k x l middle factor needs: P[(kl),(k'l')], b[kl]; with variances also T, Q, W."""
    own = f[block.at]
    k, l = own.shape[1], g.shape[1]
    gram, b = block.gram(g)
    p = np.einsum("nk,nm,nlo->klmo", own, own, gram).reshape(k * l, k * l)
    out = {"P": p, "b": (own.T @ b).ravel()}
    if f_var is not None:
        v = f_var[block.at]
        spread, square = block.sums(g_var[block.idx]), block.sums(g[block.idx] ** 2)
        out["T"] = ((v + own**2).T @ (spread + square)).ravel()
        out["Q"] = np.einsum("nk,nm,nl->lkm", own, own, spread)
        out["W"] = np.einsum("nk,nlo->klo", v, gram)
    return out


@in_parts
def middle_ratio(block: Block, f, s, g, k: int, l: int) -> np.ndarray:
    """Numerator and denominator of the multiplicative update of one middle value."""
    with np.errstate(all="ignore"):
        fk, gl = f[block.at][block.row, k], g[block.idx, l]
        p = block.products(f @ s, g)
        return np.array([(block.val * fk * gl / p).sum(), (fk * gl).sum()])


@in_parts
def middle_joint(block: Block, f, s, g) -> dict[str, np.ndarray]:
    """Numerators and denominators of the multiplicative update of all middle values at once: the minimum of the bound that
    Jensen's inequality gives of the divergence, in all of them."""
    with np.errstate(all="ignore"):
        ratio = block.val / block.products(f @ s, g)
        own, other = f[block.at], g[block.idx]
        return {"top": own.T @ block.sums(ratio[:, None] * other), "low": own.T @ block.sums(other)}


def middle_multiplicative(block: Block, f, s, g) -> np.ndarray:
    """The whole sweep over the middle values, for a block that holds all cells."""
    s = s.copy()
    with np.errstate(all="ignore"):
        p = block.products(f @ s, g)
        for k in range(s.shape[0]):
            fk = f[block.at][block.row, k]
            for l in range(s.shape[1]):
                w = fk * g[block.idx, l]
                new = s[k, l] * (block.val * w / p).sum() / w.sum()
                p = p + (new - s[k, l]) * w
                s[k, l] = new
    return s


@in_parts
def expected_error(block: Block, u, s, v, w) -> float:
    """The expected sum of squared errors: means u, v and variances s, w of the two sides."""
    own, own_var = u[block.at][block.row], s[block.at][block.row]
    o, ow = v[block.idx], w[block.idx]
    p = np.einsum("ck,ck->c", own, o)
    return float(((block.val - p) ** 2).sum() + np.einsum("ck,ck->", own_var + own**2, ow + o**2) - np.einsum("ck,ck->", own**2, o**2))


@in_parts
def expected_error_tri(block: Block, f, f_var, s, s_var, g, g_var) -> float:
    own, own_var = f[block.at][block.row], f_var[block.at][block.row]
    o, ow = g[block.idx], g_var[block.idx]
    fs, sg = own @ s, o @ s.T
    p = np.einsum("cl,cl->c", fs, o)
    both = np.einsum("cl,cl->", (own_var + own**2) @ (s_var + s**2), ow + o**2) - np.einsum("cl,cl->", own**2 @ s**2, o**2)
    rows = np.einsum("ck,ck->", own_var, sg**2 - o**2 @ (s**2).T)
    columns = np.einsum("cl,cl->", fs**2 - own**2 @ s**2, ow)
    return float(((block.val - p) ** 2).sum() + both + rows + columns)
