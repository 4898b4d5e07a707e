"""Frame curves of each clip: transform, shutter, flash gain and directional blur.

`wired` is the clip table with the transition each clip leaves and enters through, and its frame
rate: clips joined by `joins.neighbour_pairs`, plus `fps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
FLASH_PEAK = 1.6
FLASH_DECAY_SEC = 0.15
FLASH_LEAD_SEC = 0.02
BLUR_LENGTH_SCALE = 0.08
SHUTTER_PER_STRENGTH = 180.0

# The name and the tools of a clip's composition, in chain order.
NODES = ("BaseTransform", "MotionTransform", "DirectionalBlur", "PostColor")

KEY = ["project_id", "clip_id"]
OUT, IN = "outgoing_pair", "incoming_pair"


def _last() -> Column:
    return F.greatest(F.lit(0.0), F.bround(F.col("timeline_duration_sec") * F.col("fps")) - 1)


def _local(sec: Column) -> Column:
    """Frame within the clip of an instant on the timeline, to six places."""
    return F.bround((sec - F.col("timeline_in_sec")) * F.col("fps"), 6)


def _own(sec: Column) -> Column:
    return F.bround(sec * F.col("fps"), 6)


def _clamp(frame: Column) -> Column:
    # A zero keeps one sign, or equal frames would not group.
    return F.greatest(F.lit(0.0), F.least(frame, _last())) + F.lit(0.0)


# Clock of a layer's keyframes: the clip's own, or the timeline's.
OWN, LOCAL = True, False


def _layers(wired: DataFrame, *layers: tuple[str, bool]) -> DataFrame:
    """Keyframes of all layers in one pass over the clips: KEY, `frame`, keyframe `k`, number of its layer and `pos` in it.

    A clip's keyframes stay in the partition of the clip, so what groups them by clip needs no shuffle if `wired` is dealt by project.
    """
    clock = (F.col("timeline_in_sec"), F.col("timeline_duration_sec"), F.col("fps"))
    lists = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(own).alias("own"), F.col(keys).alias("keys")) for i, (keys, own) in enumerate(layers)])
    rows = wired.select(*KEY, *clock, F.explode(lists).alias("_l")).select(*KEY, *clock, F.col("_l.layer").alias("layer"), F.col("_l.own").alias("_own"), F.posexplode("_l.keys").alias("pos", "k"))
    sec = F.col("k.sec")
    return rows.select(*KEY, _clamp(F.when(F.col("_own"), _own(sec)).otherwise(_local(sec))).alias("frame"), "k", "layer", "pos")


def transform_curve(wired: DataFrame) -> DataFrame:
    """Centre and scale per frame: the outgoing transition beats the incoming one, which beats the clip."""
    values = ["center_x", "center_y", "scale"]
    rows = _layers(wired, ("transform_keyframes", OWN), (f"{IN}.incoming_keyframes", LOCAL), (f"{OUT}.outgoing_keyframes", LOCAL))
    top = rows.groupBy(*KEY, "frame").agg(F.max_by(F.struct(*[F.col(f"k.{v}").alias(v) for v in values]), F.struct("layer", "pos")).alias("_v"))
    return top.select(*KEY, "frame", *[F.col(f"_v.{v}").alias(v) for v in values])


def shutter_curve(wired: DataFrame) -> DataFrame:
    """Shutter angle per frame.

    A transition raises the clip's own value; just inside each transition the clip's baseline is
    pinned again, so its ramp stays local. Later pins win.
    """
    base = F.coalesce(F.array_max(F.transform("shutter_keyframes", lambda k: k["shutter_angle"])), F.lit(0.0))
    decay = _clamp(_local(F.element_at(F.col(f"{IN}.blur_keyframes.sec"), -1)))
    rise = _clamp(_local(F.element_at(F.col(f"{OUT}.blur_keyframes.sec"), 1)))

    def listed(role: str, keys: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), keys.alias("keys"))

    def pin(pair: str, frame: Column, pos: int) -> Column:
        made = F.struct((frame + F.lit(0.0)).alias("frame"), F.lit(None).cast("double").alias("sec"), base.alias("value"), F.lit(pos).alias("at"))
        return F.when(F.col(pair).isNotNull(), made)

    def keyed(keys: str, value) -> Column:
        return F.transform(F.col(keys), lambda k, i: F.struct(F.lit(None).cast("double").alias("frame"), k["sec"].alias("sec"), value(k).alias("value"), i.alias("at")))

    points = F.array(
        listed("own", keyed("shutter_keyframes", lambda k: k["shutter_angle"])),
        *[listed("raise", keyed(f"{pair}.blur_keyframes", lambda k: k["strength"] * SHUTTER_PER_STRENGTH)) for pair in (IN, OUT)],
        listed("pin", F.array_compact(F.array(pin(IN, F.least(decay + 1, _last()), 0), pin(OUT, F.greatest(rise - 1, F.lit(0.0)), 1)))),
    )
    clock = (F.col("timeline_in_sec"), F.col("timeline_duration_sec"), F.col("fps"))
    rows = wired.select(*KEY, *clock, F.explode(points).alias("_l")).select(*KEY, *clock, F.col("_l.role").alias("role"), F.explode("_l.keys").alias("k"))
    at = F.when(F.col("role") == "pin", F.col("k.frame")).otherwise(_clamp(F.when(F.col("role") == "own", _own(F.col("k.sec"))).otherwise(_local(F.col("k.sec")))))
    merged = rows.select(*KEY, at.alias("frame"), F.col("k.value").alias("value"), "role", F.col("k.at").alias("pos"))
    role = F.col("role")
    merged = merged.groupBy(*KEY, "frame").agg(
        F.max_by("value", F.when(role == "own", F.col("pos"))).alias("_own"),
        F.max(F.when(role == "raise", F.col("value"))).alias("_raise"),
        F.max_by("value", F.when(role == "pin", F.col("pos"))).alias("_pin"),
    )
    lifted = F.when(F.col("_raise").isNotNull(), F.greatest(F.coalesce("_own", F.lit(0.0)), "_raise")).otherwise(F.col("_own"))
    return merged.select(*KEY, "frame", F.coalesce("_pin", lifted).alias("shutter_angle"))


def flash_curve(wired: DataFrame) -> DataFrame:
    """Gain per frame around a flash: up to the peak at the cut on the way out, back to one on the way in."""
    last = _last()
    out_cut = F.least(_local(F.col(f"{OUT}.cut_sec")), last)
    before = F.greatest(F.lit(0.0), F.least(_local(F.col(f"{OUT}.cut_sec") - FLASH_LEAD_SEC), out_cut - 1))
    in_cut = F.least(_local(F.col(f"{IN}.cut_sec")), last)
    after = F.least(_local(F.col(f"{IN}.cut_sec") + FLASH_DECAY_SEC), last)
    late = F.when(last > in_cut, F.least(in_cut + 1, last)).otherwise(in_cut)
    after = F.when(after <= in_cut, late).otherwise(after)

    def point(seq: int, frame: Column, gain: float) -> Column:
        return F.struct(F.lit(seq).alias("seq"), (frame + F.lit(0.0)).alias("frame"), F.lit(gain).alias("gain"))

    def flashing(pair: str) -> Column:
        return F.coalesce(F.col(f"{pair}.effect_kind") == "flash", F.lit(False))

    sides = (
        F.when(flashing(OUT), F.array(point(0, before, 1.0), point(1, out_cut, FLASH_PEAK))),
        F.when(flashing(IN), F.array(point(2, in_cut, FLASH_PEAK), point(3, after, 1.0))),
    )
    rows = wired.where(flashing(OUT) | flashing(IN)).select(*KEY, F.inline(F.flatten(F.array_compact(F.array(*sides)))))
    return rows.groupBy(*KEY, "frame").agg(F.max_by("gain", F.col("seq")).alias("gain"))


def directional_blur_curve(wired: DataFrame) -> DataFrame:
    """Blur length and angle per frame: the strongest keyframe wins, a later one on ties.

    Clips without any blur strength have no curve; a curve that starts after frame zero is anchored
    at zero there.
    """
    def strong(pair: str) -> Column:
        return F.coalesce(F.exists(F.col(f"{pair}.blur_keyframes"), lambda k: k["strength"] > 0), F.lit(False))

    some = wired.where(strong(IN) | strong(OUT))
    rows = _layers(some, (f"{IN}.blur_keyframes", LOCAL), (f"{OUT}.blur_keyframes", LOCAL))
    length = F.col("k.strength") * BLUR_LENGTH_SCALE
    best = rows.groupBy(*KEY, "frame").agg(
        F.max_by(F.struct(length.alias("length"), F.col("k.angle").alias("angle")), F.struct(length, F.col("layer"), F.col("pos"))).alias("_v")
    ).select(*KEY, "frame", "_v.length", "_v.angle")
    # The anchor of a clip goes into its row of the first frame, so the rows are made once.
    curve = F.struct("frame", "length", "angle")
    zero = F.struct(F.lit(0.0).alias("frame"), F.lit(0.0).alias("length"), F.lit(0.0).alias("angle"))
    first = F.min("frame").over(Window.partitionBy(*KEY))
    anchored = F.when((F.col("frame") > 0) & (F.col("frame") == first), F.array(zero, curve)).otherwise(F.array(curve))
    return best.select(*KEY, anchored.alias("_r")).select(*KEY, F.inline("_r"))


def node_names(wired: DataFrame, prefix: str) -> DataFrame:
    """Composition name (a prefix before the clip's id) and node list that each clip's program must have."""
    blurred = F.lit(False)
    for pair in (IN, OUT):
        blurred = blurred | F.coalesce(F.exists(F.col(f"{pair}.blur_keyframes"), lambda k: k["strength"] > 0), F.lit(False))
    nodes = F.array_compact(F.array(*[F.when(blurred, F.lit(n)) if n == "DirectionalBlur" else F.lit(n) for n in NODES]))
    return wired.select(*KEY, F.concat(F.lit(prefix), "clip_id").alias("comp_name"), nodes.alias("nodes"))
