"""Distributions used by the factorisation models: draws, moments and modes, vectorised over numpy arrays."""

from __future__ import annotations

import math

import numpy as np

#: Below so many standard deviations the truncated normal is taken for an exponential tail (fixed value).
TAIL = 30.0


def erfc(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fromiter(map(math.erfc, x.ravel().tolist()), float, x.size).reshape(x.shape)


def digamma(x: float) -> float:
    """By recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132)))))


class RowDraws:
    """Uniform and normal numbers that depend on a key, a row's number and a count only: whatever rows are drawn for
    together, and in whichever task, a row gets the same numbers."""

    def __init__(self, key: tuple[int, ...], rows: np.ndarray):
        state = np.array(rows, np.uint64)
        for x in key:
            state = self._mix(state ^ np.uint64(x % 2**64))
        self.state, self.at, self.count = state, np.arange(len(state)), 0

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        """The finaliser of splitmix64."""
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def begin(self, no: int) -> None:
        """The next numbers are those of the no-th draw of each row."""
        self.count = no << 32

    def random(self, _=None) -> np.ndarray:
        self.count += 1
        return ((self._mix(self.state[self.at] ^ self._mix(np.array([self.count], np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2**53

    def standard_normal(self, _=None) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.random())) * np.cos(2 * math.pi * self.random())


def exponential_draw(rate, rng: np.random.Generator, size=None) -> np.ndarray:
    return rng.exponential(1.0 / np.asarray(rate, float), size)


def gamma_draw(alpha: float, beta: float, rng: np.random.Generator) -> float:
    return float(rng.gamma(alpha, 1.0 / beta))


def gamma_expectation(alpha: float, beta: float) -> float:
    return alpha / beta


def gamma_expectation_log(alpha: float, beta: float) -> float:
    return digamma(alpha) - math.log(beta)


def gamma_mode(alpha: float, beta: float) -> float:
    return (alpha - 1.0) / beta


def normal_draw(mu, tau, rng: np.random.Generator, size=None) -> np.ndarray:
    return rng.normal(mu, 1.0 / np.sqrt(tau), size)


def _hazard(x: np.ndarray) -> np.ndarray:
    """Density over upper tail of the standard normal."""
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) / (0.5 * erfc(x / math.sqrt(2)))


def tn_moments(mu, tau) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of N(mu, 1/tau) truncated to [0, inf); whatever is not finite or negative is 0."""
    mu, tau = np.broadcast_arrays(np.asarray(mu, float), np.asarray(tau, float))
    with np.errstate(all="ignore"):
        sigma = 1 / np.sqrt(tau)
        far = mu < -TAIL * sigma
        x = np.where(far | ~np.isfinite(sigma), 0.0, -mu / sigma)
        h = _hazard(x)
        mean = np.where(far, 1 / (np.abs(mu) * tau), mu + sigma * h)
        var = np.where(far, (1 / (np.abs(mu) * tau)) ** 2, sigma**2 * (1 - h * (h - x)))
    clean = lambda v: np.where(np.isfinite(v) & (v >= 0), v, 0.0)
    return clean(mean), clean(var)


def tn_expectation(mu, tau) -> np.ndarray:
    return tn_moments(mu, tau)[0]


def tn_variance(mu, tau) -> np.ndarray:
    return tn_moments(mu, tau)[1]


def tn_mode(mu) -> np.ndarray:
    return np.maximum(0.0, mu)


def truncated_standard(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws of the standard normal between a and b (arrays), by rejection from the proposal that fits each interval:
    the normal itself, a shifted exponential in a far tail, the uniform on a short interval (Robert 1995)."""
    flip = b <= 0
    lo, hi = np.where(flip, -b, a), np.where(flip, -a, b)
    out = np.empty(lo.shape)
    todo = np.arange(lo.size)
    lo, hi, flat = lo.ravel(), hi.ravel(), out.ravel()
    while len(todo):
        x, y = lo[todo], hi[todo]
        if isinstance(rng, RowDraws):
            rng.at = todo
        rate = (x + np.sqrt(x * x + 4)) / 2
        # Distance over which the density falls by a factor of e decides between the uniform and the others.
        short = (y - x) < np.where(x > 0, 1 / np.maximum(rate, 1e-300), 1.0)
        tail = ~short & (x > 0.45)
        u = rng.random(len(todo))
        draw = rng.standard_normal(len(todo))
        draw = np.where(tail, x - np.log1p(-rng.random(len(todo))) / rate, draw)
        with np.errstate(invalid="ignore"):
            draw = np.where(short, x + (y - x) * rng.random(len(todo)), draw)
        top = np.where((x <= 0) & (y >= 0), 0.0, np.minimum(np.abs(x), np.abs(y)))
        accept = np.where(tail, np.exp(-0.5 * (draw - rate) ** 2), np.where(short, np.exp(0.5 * (top**2 - draw**2)), 1.0))
        good = (draw >= x) & (draw <= y) & (u <= accept)
        flat[todo[good]] = draw[good]
        todo = todo[~good]
    return np.where(flip, -flat.reshape(out.shape), flat.reshape(out.shape))


def truncated_normal(a, b, mu, sigma, rng: np.random.Generator, density: bool = False):
    """Draws of N(mu, sigma^2) between a and b; with density, their densities too."""
    a, b, mu, sigma = np.broadcast_arrays(*(np.asarray(x, float) for x in (a, b, mu, sigma)))
    if (a >= b).any():
        raise ValueError("a must be less than b")
    lo, hi = (a - mu) / sigma, (b - mu) / sigma
    z = truncated_standard(lo, hi, rng)
    x = np.clip(mu + sigma * z, a, b)
    if not density:
        return x
    upper = lambda v: 0.5 * erfc(v / math.sqrt(2))
    mass = np.where(lo > 0, upper(lo) - upper(hi), upper(-hi) - upper(-lo))
    return x, np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * sigma * mass)


def tn_draw(mu, tau, rng: np.random.Generator) -> np.ndarray:
    """Draws of N(mu, 1/tau) truncated to [0, inf); 0 where tau is 0 or the draw is not finite."""
    mu, tau = np.broadcast_arrays(np.asarray(mu, float), np.asarray(tau, float))
    ok = np.isfinite(mu) & np.isfinite(tau) & (tau > 0)
    sigma = 1 / np.sqrt(np.where(ok, tau, 1.0))
    m = np.where(ok, mu, 0.0)
    x = m + sigma * truncated_standard(-m / sigma, np.full(m.shape, np.inf), rng)
    return np.where(ok & np.isfinite(x) & (x > 0), x, 0.0)


def log_half_erfc(z) -> np.ndarray:
    """ln(erfc(z)/2), by the asymptotic series where erfc underflows."""
    z = np.asarray(z, float)
    far = z > 25
    safe = np.where(far, 0.0, z)
    y = np.where(far, z, 1.0)
    tail = -y * y - np.log(2 * y * math.sqrt(math.pi)) + np.log1p(-1 / (2 * y * y) + 3 / (4 * y**4))
    return np.where(far, tail, np.log(0.5 * erfc(safe)))
