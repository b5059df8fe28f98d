"""Sensor-mount rotations as column arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def tilt_matrix(x: Column, y: Column, z: Column) -> Column:
    """The rotation that brings a gravity reading onto +z, as nine doubles.

    With the unit reading (a, b, c) Rodrigues' formula has the closed form below;
    level and zero readings give the identity, an upside-down one a half turn
    about x.
    """
    norm = F.sqrt(x * x + y * y + z * z)
    zero = norm < EPS
    a, b = F.when(zero, 0.0).otherwise(x / norm), F.when(zero, 0.0).otherwise(y / norm)
    c = F.when(zero, 1.0).otherwise(z / norm)
    s2 = a * a + b * b
    k = (1 - c) / s2
    one, nil = F.lit(1.0), F.lit(0.0)
    turn = [1 - k * a * a, -k * a * b, -a, -k * a * b, 1 - k * b * b, -b, a, b, 1 - k * s2]
    level = F.array(one, nil, nil, nil, one, nil, nil, nil, one)
    flip = F.array(one, nil, nil, nil, -one, nil, nil, nil, -one)
    return F.when(F.sqrt(s2) >= EPS, F.array(*turn)).when(c > 0, level).otherwise(flip)


def apply_matrix(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """C3."""
    return [m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z for i in range(3)]


def to_forward(x: Column, y: Column, yaw_deg: Column) -> tuple[Column, Column]:
    """Turn the level plane so that +x points forward."""
    c, s = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    return c * x + s * y, c * y - s * x


def wrapped_diff(a: Column, b: Column) -> Column:
    """Size of the angle between two headings in degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def tilt_array(g: np.ndarray) -> np.ndarray:
    """The same rotation for one reading inside a task."""
    norm = float(np.linalg.norm(g))
    a, b, c = (g / norm) if norm >= EPS else (0.0, 0.0, 1.0)
    s2 = a * a + b * b
    if np.sqrt(s2) < EPS:
        return np.diag([1.0, 1.0, 1.0]) if c > 0 else np.diag([1.0, -1.0, -1.0])
    k = (1 - c) / s2
    return np.array([[1 - k * a * a, -k * a * b, -a], [-k * a * b, 1 - k * b * b, -b], [a, b, 1 - k * s2]])
