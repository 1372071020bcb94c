"""Draws as DataFrame columns: each is a function of a seed, the row's key columns and a count, so that it is the same under
any partitioning, on a retry, and in any engine that has md5.

A digest of seed|keys|count gives two uniform numbers of 52 bits. Draws by rejection (gamma: Marsaglia and Tsang; normal above
zero: Robert) take the first of ATTEMPTS digests that is accepted; later ones are not evaluated. Acceptance is a half at least,
so that none of them is accepted in fewer than one row of 2**60.

Cases: null keys count as the word null; null parameters give null; a precision, rate or shape that is not above zero, or not
finite, gives null (normal above zero: 0, as where a factor has no weight).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digests that a draw by rejection may use.
ATTEMPTS = 64


def digest(seed: int, keys: list, count) -> Column:
    parts = [F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("null")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, (count if isinstance(count, Column) else F.lit(count)).cast("string")))


def part(h: Column, no: int) -> Column:
    """The first (0) or second (1) uniform number of a digest, between 0 and 1."""
    return (F.conv(F.substring(h, 1 + 13 * no, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(h: Column) -> Column:
    return F.sqrt(-2 * F.ln(part(h, 0))) * F.cos(2 * math.pi * part(h, 1))


def _positive(x: Column) -> Column:
    return (x > 0) & (x < float("inf"))


def uniform(seed: int, keys: list, count: int = 0) -> Column:
    return part(digest(seed, keys, count), 0)


def exponential(rate: Column, seed: int, keys: list, count: int = 0) -> Column:
    return F.when(_positive(rate), -F.ln(uniform(seed, keys, count)) / rate)


def normal(mu: Column, tau: Column, seed: int, keys: list, count: int = 0) -> Column:
    """N(mu, 1/tau)."""
    return F.when(_positive(tau), mu + _normal(digest(seed, keys, count)) / F.sqrt(tau))


def _first(seed: int, keys: list, count: int, accepted) -> Column:
    """accepted(digest) of the first attempt for which it is not null."""
    tries = F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))
    return F.aggregate(tries, F.lit(None).cast("double"), lambda found, n: F.coalesce(found, accepted(digest(seed, keys, F.concat_ws(".", F.lit(str(count)), n.cast("string"))))))


def normal_above_zero(mu: Column, tau: Column, seed: int, keys: list, count: int = 0) -> Column:
    """N(mu, 1/tau) where it is above zero. A tail (mu below 0) is proposed from the exponential that fits it best."""
    sigma = 1 / F.sqrt(F.when(_positive(tau), tau))
    low = -mu / sigma
    rate = (low + F.sqrt(low * low + 4)) / 2

    def accepted(h: Column) -> Column:
        tail, middle = low - F.ln(part(h, 0)) / rate, _normal(h)
        return F.when(low > 0, F.when(part(h, 1) <= F.exp(-0.5 * (tail - rate) * (tail - rate)), tail)).otherwise(F.when(middle >= low, middle))

    z = F.coalesce(_first(seed, keys, count, accepted), F.greatest(low, F.lit(0.0)))
    usable = _positive(tau) & (F.abs(mu) < float("inf"))
    return F.when(mu.isNull() | tau.isNull(), F.lit(None).cast("double")).when(usable, F.greatest(mu + sigma * z, F.lit(0.0))).otherwise(F.lit(0.0))


def gamma(alpha: Column, beta: Column, seed: int, keys: list, count: int = 0) -> Column:
    """Gamma of shape alpha and rate beta. Shapes below 1 are drawn one higher and scaled by a power of a uniform number."""
    ok = _positive(alpha) & _positive(beta)
    shape = F.when(ok, F.when(alpha < 1, alpha + 1).otherwise(alpha))
    d = shape - 1 / 3
    c = 1 / F.sqrt(9 * d)

    def accepted(h: Column) -> Column:
        x = _normal(h)
        v = F.pow(1 + c * x, F.lit(3.0))
        # The uniform number of the digest's digest: the first has given both of its own.
        u = part(F.md5(h), 0)
        return F.when((v > 0) & (F.ln(u) < 0.5 * x * x + d - d * v + d * F.ln(F.when(v > 0, v))), d * v)

    drawn = F.coalesce(_first(seed, keys, count, accepted), d)
    less = F.when(alpha < 1, F.pow(uniform(seed, keys, count + 1), 1 / alpha)).otherwise(F.lit(1.0))
    return F.when(ok, drawn * less / beta)
