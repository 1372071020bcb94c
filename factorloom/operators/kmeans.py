"""K-means of partially observed points: distances and centres use known coordinates only.

Points are the rows of one side of a matrix and coordinates those of the other (see sides.py). Distances are summed over
the cells that are there, so memory follows the cells of a block, not its points times coordinates.

fit_sides() gives an array of clusters, for beginnings of models; fit_table() leaves points where they are: a pass over them
gives the sums of each cluster and the few points that are furthest from their centres, and the driver holds the centres.

Cases: a point without cells is refused; a coordinate that no point has is dropped; ties go to the lowest cluster, and
distances that differ by rounding only are ties, so that the order of a point's cells decides nothing; a point that shares no coordinate with any centre goes to the last; an empty cluster takes the point furthest from its
own centre, or a new random centre where there are fewer distinct points than clusters.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block

#: Passes at most (fixed value: the loop ends when its counter reaches 200).
MAX_PASSES = 199
#: Distances this near to the least one, in proportion, are ties.
ROUNDING = 1e-12


def one_hot(assigned: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(assigned), k))
    out[np.arange(len(assigned)), assigned] = 1.0
    return out


def distances(block: Block, centres: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Mean squared distance of each point to each centre over coordinates known to both; inf where there are none. Only
    cells are touched."""
    out = np.full((len(block.ids), len(centres)), np.inf)
    for c in range(len(centres)):
        known = have[c, block.idx]
        shared = np.bincount(block.row, known, len(block.ids))
        square = np.bincount(block.row, known * (block.val - centres[c, block.idx]) ** 2, len(block.ids))
        out[:, c] = np.divide(square, shared, out=out[:, c], where=shared > 0)
    return out


def _chosen(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distances to all centres the nearest (the last where none is known) and the distance (then nan)."""
    best = (d <= d.min(1, keepdims=True) * (1 + ROUNDING)).argmax(1)
    best[np.isinf(d).all(1)] = d.shape[1] - 1
    own = d[np.arange(len(d)), best]
    return best, np.where(np.isinf(own), np.nan, own)


def assign(x: np.ndarray, known: np.ndarray, centres: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point by mean squared distance over coordinates known to both. Also the distances (nan
    where unknown)."""
    shared = known @ have.T
    square = (known * x**2) @ have.T - 2 * (known * x) @ (have * centres).T + known @ (have * centres**2).T
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.maximum(square, 0) / shared
    d[shared == 0] = np.inf
    return _chosen(d)


def nearest(block: Block, centres: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Cluster and distance of each point of a block."""
    return np.stack(_chosen(distances(block, centres, have)), 1).astype(float)


class Furthest:
    """The points furthest from their centres (distance, point, cluster, coordinates, values), so many at most. Merged by +."""

    def __init__(self, rows: list[tuple], most: int):
        self.rows, self.most = sorted(rows, key=lambda r: (-r[0], r[1]))[:most], most

    def __add__(self, other: Furthest) -> Furthest:
        return Furthest(self.rows + other.rows, self.most)


def table_pass(block: Block, centres: np.ndarray, have: np.ndarray) -> dict:
    """Sums and counts of the coordinates of each cluster's points, members of each, and the furthest points."""
    k, m = centres.shape
    best, d = _chosen(distances(block, centres, have))
    at = best[block.row] * m + block.idx
    out = {"sum": np.bincount(at, block.val, k * m).reshape(k, m), "count": np.bincount(at, minlength=k * m).reshape(k, m).astype(float), "members": np.bincount(best, minlength=k)}
    known = np.flatnonzero(~np.isnan(d))
    far = known[np.lexsort((block.ids[known], -d[known]))][: 2 * k]
    cells = [slice(block.ptr[p], block.ptr[p + 1]) for p in far]
    return out | {"far": Furthest([(float(d[p]), int(block.ids[p]), int(best[p]), block.idx[c].copy(), block.val[c].copy()) for p, c in zip(far, cells)], 2 * k)}


def member_sums(block: Block, assigned: np.ndarray, k: int, m: int) -> dict[str, np.ndarray]:
    """Sums and counts of the coordinates of each cluster's points."""
    at = assigned[block.ids][block.row] * m + block.idx
    return {"sum": np.bincount(at, block.val, k * m).reshape(k, m), "count": np.bincount(at, minlength=k * m).reshape(k, m).astype(float)}


def centres_of(obs: DataFrame, clusters: DataFrame, by: str = "i", coordinate: str = "j", value: str = "r") -> DataFrame:
    """The centres (cluster, coordinate, centre, cells) of assigned points, as one aggregation: for tables of any size."""
    return obs.join(clusters, by).groupBy("cluster", coordinate).agg(F.avg(value).alias("centre"), F.count("*").alias("cells"))


def _range(block: Block) -> np.ndarray:
    """Least and greatest value of each row."""
    out = np.stack((np.full(len(block.ids), np.inf), np.full(len(block.ids), -np.inf)), 1)
    np.minimum.at(out[:, 0], block.row, block.val)
    np.maximum.at(out[:, 1], block.row, block.val)
    return out


def _print(block: Block) -> np.ndarray:
    """A number for each row that equal rows share: a sum of pseudo-random multiples of its values."""
    weight = np.sin(block.idx * 12.9898 + 1) * 43758.5453 % 1 + 0.5
    return np.bincount(block.row, np.round(block.val * weight, 9), len(block.ids))[:, None]


class MaskedKMeans:
    """k clusters of the rows of a side. passes: at most so many over the points."""

    def __init__(self, k: int, seed: int = 0, passes: int = MAX_PASSES):
        if k <= 0:
            raise ValueError("K should be greater than 0.")
        self.k, self.rng, self.passes = k, np.random.default_rng([seed, 29]), passes

    def fit(self, i, j, r, n: int, m: int) -> np.ndarray:
        """The cluster of each of n points with coordinates r at (i, j), in this process."""
        from .sides import LocalSide

        i, j = np.asarray(i), np.asarray(j)
        empty = np.flatnonzero(np.bincount(i, minlength=n) == 0)
        if len(empty):
            raise ValueError(f"Fully unobserved row in X, row {int(empty[0])}.")
        return self.fit_sides(LocalSide(Block.of(i, j, np.asarray(r, float), n)), LocalSide(Block.of(j, i, np.asarray(r, float), m)))

    def fit_sides(self, points, coordinates) -> np.ndarray:
        """The cluster of each row of points; coordinates: the same cells by column."""
        m = coordinates.n
        bounds = coordinates.rows(_range)
        seen = np.isfinite(bounds[:, 0]) & (bounds[:, 1] >= bounds[:, 0])
        self.low, self.high = np.where(seen, bounds[:, 0], 0.0), np.where(seen, bounds[:, 1], 0.0)
        distinct = len(np.unique(points.rows(_print)))
        if self.k > points.n or self.k > distinct:
            warnings.warn(f"More clusters ({self.k}) than points or distinct points ({points.n}, {distinct}).", stacklevel=2)
        centres, have = np.stack([self._random() for _ in range(self.k)]), np.tile(seen.astype(float), (self.k, 1))
        assigned = np.full(points.n, -1)
        for _ in range(self.passes):
            out = points.rows(nearest, centres, have)
            new, distance = out[:, 0].astype(int), out[:, 1]
            if (new == assigned).all():
                break
            assigned = self._filled(new, distance, distinct)
            sums = points.sums(member_sums, assigned, self.k, m)
            with np.errstate(invalid="ignore", divide="ignore"):
                centres = np.where(sums["count"] > 0, sums["sum"] / sums["count"], 0.0)
            have = (sums["count"] > 0).astype(float)
            for c in np.flatnonzero(np.bincount(assigned, minlength=self.k) == 0):
                centres[c], have[c] = self._random(), seen.astype(float)
        self.centres, self.have = centres, have
        return assigned

    def fit_table(self, points, coordinates, centres: np.ndarray | None = None) -> DataFrame:
        """idx and cluster of each point, on executors; centres: where to begin (else at random).

        The loop ends when a pass gives the sums of the one before. An empty cluster takes the furthest point, as above;
        where points run out (fewer distinct ones than clusters) it gets a random centre."""
        bounds = coordinates.rows(_range)
        seen = np.isfinite(bounds[:, 0]) & (bounds[:, 1] >= bounds[:, 0])
        self.low, self.high = np.where(seen, bounds[:, 0], 0.0), np.where(seen, bounds[:, 1], 0.0)
        distinct = points.frame(_print).agg(F.countDistinct("vec")).first()[0]
        if self.k > points.n or self.k > distinct:
            warnings.warn(f"More clusters ({self.k}) than points or distinct points ({points.n}, {distinct}).", stacklevel=2)
        centres = np.stack([self._random() for _ in range(self.k)]) if centres is None else np.asarray(centres, float)
        have, last = np.tile(seen.astype(float), (self.k, 1)), None
        for _ in range(self.passes):
            sums = points.sums(table_pass, centres, have)
            if last is not None and all((sums[x] == last[x]).all() for x in ("sum", "count")):
                break
            last = {x: sums[x].copy() for x in ("sum", "count")}
            if distinct >= self.k:
                self._moved(sums)
            with np.errstate(invalid="ignore", divide="ignore"):
                centres = np.where(sums["count"] > 0, sums["sum"] / sums["count"], 0.0)
            have = (sums["count"] > 0).astype(float)
            for c in np.flatnonzero(sums["members"] == 0):
                centres[c], have[c] = self._random(), seen.astype(float)
        self.centres, self.have = centres, have
        return points.frame(nearest, centres, have).select("idx", F.element_at("vec", 1).cast("int").alias("cluster"))

    @staticmethod
    def _moved(sums: dict) -> None:
        """Give each empty cluster the furthest point that is left; a donor emptied by that is looked at again."""
        for _, _, donor, idx, val in sums["far"].rows:
            empty = np.flatnonzero(sums["members"] == 0)
            if not len(empty):
                return
            for c, sign in ((donor, -1), (empty[0], 1)):
                sums["sum"][c, idx] += sign * val
                sums["count"][c, idx] += sign
                sums["members"][c] += sign
            sums["sum"][sums["count"] == 0] = 0.0

    def _random(self) -> np.ndarray:
        return self.rng.uniform(self.low, self.high)

    def _filled(self, assigned: np.ndarray, distance: np.ndarray, distinct: int) -> np.ndarray:
        """Each empty cluster takes the furthest point; a donor emptied by that is looked at again."""
        assigned, left = assigned.copy(), np.nan_to_num(distance, nan=-1.0)
        while distinct >= self.k and len(empty := np.flatnonzero(np.bincount(assigned, minlength=self.k) == 0)) and (left >= 0).any():
            far = int(left.argmax())
            assigned[far], left[far] = empty[0], -1.0
        return assigned
