"""Positions and rotations in space: arrays of three numbers, quaternions (w, x, y, z), matrices of nine by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.vectors import dot, minus, norm


def rotated_back(rotation: Column, v: Column) -> Column:
    """``v`` by the transposed matrix: from the outer frame into the rotated one."""
    at = lambda k: F.get(rotation, F.lit(k))
    x, y, z = (F.get(v, F.lit(k)) for k in range(3))
    return F.array(*[at(k) * x + at(k + 3) * y + at(k + 6) * z for k in range(3)])


def in_head_frame(point: Column, head: Column, rotation: Column, origin: Column) -> Column:
    """``point`` as the head at its first frame sees it, less the wrist's place there, ``origin``, seen the same way."""
    return minus(rotated_back(rotation, minus(point, head)), rotated_back(rotation, minus(origin, head)))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def turn(a: Column, b: Column) -> Column:
    """The angle in radians between two orientations, as unit quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def flat(parts: Column, *scalars: Column) -> Column:
    """An array of arrays in one, with the scalars behind."""
    return F.concat(F.flatten(parts), F.array(*scalars))
