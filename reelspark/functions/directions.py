"""Screen directions (y grows downward)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The eight compass names in angle order, 45 degrees apart, starting at +x.
COMPASS = ("right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right")

# Unit vectors of the nine direction labels.
VECTORS = {
    "none": (0.0, 0.0),
    "left": (-1.0, 0.0),
    "right": (1.0, 0.0),
    "up": (0.0, -1.0),
    "down": (0.0, 1.0),
    "up-left": (-0.7071, -0.7071),
    "up-right": (0.7071, -0.7071),
    "down-left": (-0.7071, 0.7071),
    "down-right": (0.7071, 0.7071),
}

MIN_BUCKET_MAGNITUDE = 2.0


def _names() -> Column:
    return F.array(*[F.lit(n) for n in COMPASS])


def bucket(tx: Column, ty: Column, min_magnitude: float = MIN_BUCKET_MAGNITUDE) -> Column:
    """Nearest of eight directions; a half-way angle goes to the label listed first."""
    angle = F.pmod(F.degrees(F.atan2(ty, tx)), F.lit(360.0))
    step = F.pmod(F.ceil((angle - 22.5) / 45.0).cast("int"), F.lit(8))
    step = F.when(angle == 337.5, F.lit(0)).otherwise(step)
    return F.when(F.hypot(tx, ty) < min_magnitude, F.lit("none")).otherwise(F.element_at(_names(), step + 1))


def flow_label(vx: Column, vy: Column) -> Column:
    """Label of a flow vector as the recorded measurements carry it (half a turn from `bucket`)."""
    turned = F.pmod(F.degrees(F.atan2(vy, vx)) + 202.5, F.lit(360.0))
    return F.element_at(_names(), F.floor(turned / 45.0).cast("int") + 1)


def _component(label: Column, axis: int) -> Column:
    pairs = [part for name, vector in VECTORS.items() for part in (F.lit(name), F.lit(vector[axis]))]
    return F.element_at(F.create_map(*pairs), label)


def vector_x(label: Column) -> Column:
    return _component(label, 0)


def vector_y(label: Column) -> Column:
    return _component(label, 1)


def cosine(a: Column, b: Column) -> Column:
    """Agreement of two labels in [-1, 1]; zero when either makes no claim."""
    dot = vector_x(a) * vector_x(b) + vector_y(a) * vector_y(b)
    return F.when((a == "none") | (b == "none"), F.lit(0.0)).otherwise(dot)


def similarity(a: Column, b: Column) -> Column:
    """Agreement of two labels in [0, 1]; .75 when either makes no claim."""
    dot = vector_x(a) * vector_x(b) + vector_y(a) * vector_y(b)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot + 1.0) / 2.0))
    return F.when((a == "none") | (b == "none"), F.lit(0.75)).otherwise(scaled)
