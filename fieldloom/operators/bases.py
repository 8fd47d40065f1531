"""Interpolation of bases of modes over a parameter, on the manifold of their subspaces.

Bases are tall tables (param, mode, point, phi) of orthonormal modes. All that the geometry needs are the modes' inner
products, which one aggregate over points sums; rotations, logarithm and exponential are then small matrices, and the
interpolated basis is a linear combination of the two neighbouring ones, one more aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES_AT_MOST, MODES_AT_MOST = 64, 64
STEEPEST = 1.0  # greatest tangent of an angle between two bases that the logarithm takes


@dataclass
class Products:
    """params ascending, modes, and the inner products [i, a, j, b] of mode a of basis i with mode b of basis j."""

    params: list
    modes: list
    g: np.ndarray

    def pair(self, i: int, j: int) -> np.ndarray:
        return self.g[i, :, j, :]

    def rotation(self, i: int) -> np.ndarray:
        """The orthogonal matrix that brings basis i closest to the first one."""
        u, _, vt = np.linalg.svd(self.pair(0, i))
        return vt.T @ u.T


def products(bases: DataFrame, param: str = "param", mode: str = "mode", point: str = "point", value: str = "phi") -> Products:
    """Inner products of all modes. One shuffle on points, whose groups hold bases x modes numbers at most, then sums."""
    head = bases.select(param, mode).distinct().limit(BASES_AT_MOST * MODES_AT_MOST + 1).collect()
    params, modes = sorted({r[0] for r in head}), sorted({r[1] for r in head})
    if len(params) > BASES_AT_MOST or len(modes) > MODES_AT_MOST:
        raise ValueError(f"at most {BASES_AT_MOST} bases of {MODES_AT_MOST} modes")
    if len(head) != len(params) * len(modes):
        raise ValueError("bases differ in their modes")
    x = bases.groupBy(F.col(point)).agg(F.collect_list(F.struct(F.col(param).alias("p"), F.col(mode).alias("m"), F.col(value).cast("double").alias("x"))).alias("r"))
    pairs = x.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b")).filter("a.p <= b.p")
    sums = pairs.groupBy("a.p", "a.m", F.col("b.p").alias("q"), F.col("b.m").alias("o")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("g")).collect()
    at, of = {p: i for i, p in enumerate(params)}, {m: i for i, m in enumerate(modes)}
    g = np.zeros((len(params), len(modes)) * 2)
    for p, m, q, o, v in sums:
        g[at[p], of[m], at[q], of[o]] = g[at[q], of[o], at[p], of[m]] = v
    return Products(params, modes, g)


def distance_curve(inner: Products) -> list[float]:
    """Chordal distances of neighbouring bases: the root of the sum of squared sines of their principal angles."""
    out = []
    for i in range(len(inner.params) - 1):
        c = np.clip(np.linalg.svd(inner.pair(i, i + 1), compute_uv=False), -1, 1)
        out.append(float(np.sqrt((1 - c * c).sum())))
    return out


def combination(inner: Products, target: float, steepest: float | None = STEEPEST) -> list[tuple[int, np.ndarray]]:
    """[(i, A)]: the basis at target is the sum of basis i times A. Beyond the ends it is the first or the last one, brought close to the first."""
    p = np.array([float(x) for x in inner.params])
    if len(p) < 2:
        raise ValueError("two bases at least")
    if target <= p[0] or target >= p[-1]:
        i = 0 if target <= p[0] else len(p) - 1
        return [(i, inner.rotation(i))]
    i = int(np.searchsorted(p, target))
    t = (target - p[i - 1]) / (p[i] - p[i - 1])
    r0, r1 = inner.rotation(i - 1), inner.rotation(i)
    g0, c, g1 = r0.T @ inner.pair(i - 1, i - 1) @ r0, r0.T @ inner.pair(i - 1, i) @ r1, r1.T @ inner.pair(i, i) @ r1
    inv = np.linalg.pinv(c)
    # Tangents M = Y1 inv - Y0 p of the principal angles, by the eigenvectors of M'M.
    keep = c @ inv
    square = inv.T @ g1 @ inv - inv.T @ c.T @ keep - keep.T @ c @ inv + keep.T @ g0 @ keep
    w, v = np.linalg.eigh((square + square.T) / 2)
    tan = np.sqrt(np.maximum(w, 0))
    angle = np.arctan(np.minimum(tan, steepest) if steepest is not None else tan)
    side = v @ np.diag(np.where(tan > 1e-12, np.sin(t * angle) / np.maximum(tan, 1e-300), t)) @ v.T
    a, b = v @ np.diag(np.cos(t * angle)) @ v.T - keep @ side, inv @ side
    gram = a.T @ g0 @ a + a.T @ c @ b + b.T @ c.T @ a + b.T @ g1 @ b
    upright = np.linalg.inv(np.linalg.cholesky(gram)).T  # orthonormal again, each mode on the side where it was
    return [(i - 1, r0 @ a @ upright), (i, r1 @ b @ upright)]


def basis_interpolate(bases: DataFrame, target: float, param: str = "param", mode: str = "mode", point: str = "point", value: str = "phi", steepest: float | None = STEEPEST) -> tuple[DataFrame, list[float]]:
    """The basis (mode, point, phi) at a target between bases (param, mode, point, phi), and the distances of neighbouring bases.

    Bases are turned close to the first one; between two of them the modes follow the geodesic of their subspaces.
    Angles whose tangent exceeds ``steepest`` count as that steep, unless it is None. A point that a basis lacks is 0 there.
    """
    inner = products(bases, param, mode, point, value)
    rows = [(inner.params[i], inner.modes[a], inner.modes[b], float(m[a, b])) for i, m in combination(inner, target, steepest) for a in range(len(m)) for b in range(len(m))]
    kinds = dict(bases.dtypes)
    turn = bases.sparkSession.createDataFrame(rows, f"`{param}` {kinds[param]}, `{mode}` {kinds[mode]}, to_ {kinds[mode]}, w_ double")
    out = bases.join(F.broadcast(turn), [param, mode]).groupBy(F.col("to_").alias(mode), point).agg(F.sum(F.col(value) * F.col("w_")).alias(value))
    return out, distance_curve(inner)
