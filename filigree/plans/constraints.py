"""Constraints on an embedding, as projections of NumPy blocks (n, m)."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np


class Constraint(ABC):
    """Extend with a start, a projection onto the set and one onto its tangent space."""

    name = "constraint"

    @abstractmethod
    def initial(self, n: int, m: int, rng: np.random.Generator) -> np.ndarray: ...

    @abstractmethod
    def project(self, z: np.ndarray) -> np.ndarray: ...

    def tangent(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return z


class Centered(Constraint):
    """Mean zero."""

    name = "centered"

    def initial(self, n, m, rng):
        return self.project(rng.standard_normal((n, m)))

    def project(self, z):
        return z - z.mean(axis=0)


class Standardized(Constraint):
    """Mean zero and X'X/n the identity."""

    name = "standardized"

    def initial(self, n, m, rng):
        return self.project(rng.standard_normal((n, m)))

    def project(self, z):
        z = z - z.mean(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z)
        if values[0] <= 1e-14 * max(values[-1], 1e-300):
            u, _, vt = np.linalg.svd(z, full_matrices=False)
            return np.sqrt(len(z)) * u @ vt
        return z @ (vectors * np.sqrt(len(z) / values)) @ vectors.T

    def tangent(self, x, z):
        return z - x @ (z.T @ x) / len(x)


class Anchored(Constraint):
    """Some items pinned: index array and their values."""

    name = "anchored"

    def __init__(self, anchors, values):
        self.anchors, self.values = np.asarray(anchors, np.int64), np.asarray(values, float)
        if len(self.anchors) != len(self.values):
            raise ValueError("one value per anchor")

    def initial(self, n, m, rng):
        return self.project(rng.standard_normal((n, m)))

    def project(self, z):
        out = z.copy()
        out[self.anchors] = self.values
        return out

    def tangent(self, x, z):
        out = z.copy()
        out[self.anchors] = 0
        return out


class Sphere(Constraint):
    """Every item at the given distance from the origin."""

    name = "sphere"

    def __init__(self, radius: float = 1.0):
        self.radius = radius

    def initial(self, n, m, rng):
        return self.project(rng.standard_normal((n, m)))

    def project(self, z):
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return self.radius * z / np.where(size > 0, size, 1)

    def tangent(self, x, z):
        return z - (z * x).sum(axis=1, keepdims=True) * x / self.radius**2
