"""Exact frame and second conversions over rational frame rates (num / den frames per second)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Broadcast rates by their three-decimal spelling.
BROADCAST_RATES = {
    23.976: (24000, 1001),
    23.98: (24000, 1001),
    29.97: (30000, 1001),
    59.94: (60000, 1001),
    47.952: (48000, 1001),
    119.88: (120000, 1001),
}
# Seconds count as the closest fraction whose denominator is at most this.
MOST_DENOMINATOR = 1_000_000_000


def _long(value: Column) -> Column:
    return value.cast("bigint")


def _whole(value: Column, digits: int = 38) -> Column:
    return value.cast(f"decimal({digits},0)")


def _gcd(a: Column, b: Column) -> Column:
    def euclid(s, _):
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(_long(a).alias("a"), _long(b).alias("b")), euclid, lambda s: s["a"])


def _inverse(a: Column, m: Column) -> Column:
    """Inverse of a modulo m, for coprime numbers; zero modulo one."""

    def state(r0, r1, t0, t1):
        return F.struct(_long(r0).alias("r0"), _long(r1).alias("r1"), _long(t0).alias("t0"), _long(t1).alias("t1"))

    def step(s, _):
        q = _div(s["r0"], s["r1"])
        return F.when(s["r1"] == 0, s).otherwise(state(s["r1"], s["r0"] - q * s["r1"], s["t1"], s["t0"] - q * s["t1"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), state(m, F.pmod(a, m), F.lit(0), F.lit(1)), step, lambda s: F.pmod(s["t0"], m))


def _side(sec: Column, half: Column, num: Column, den: Column) -> Column:
    """Where an instant lies against a half frame: -1 before it, 0 on it, 1 after it.

    Away from the half frame the double product decides. Near it everything is exact: the double is
    an integer times a power of two, its distance to the half frame p / d a difference of decimals. The
    instant counts as on it when no fraction of a denominator up to `MOST_DENOMINATOR` is closer, that
    is when it is less than half way to the neighbour of p / d among those fractions, 1 / (d * q) away. The
    neighbour's denominator q is the largest in one residue class of d, so it is within d of the limit
    and is only worked out where that matters.
    """
    two = _long(num) * 2
    away = sec * two / den - half
    sign = F.signum(away).cast("int")
    # The double of a half frame is on it while fractions of such denominators lie further apart than doubles do.
    itself = (sec == (half * _long(den)).cast("double") / two.cast("double")) & (sec * two < 2.0**52 / MOST_DENOMINATOR)
    # Away from a half frame nothing of the long exact part is evaluated.
    exact = _let({"sec": sec, "half": half, "two": two, "den": _long(den)}, _exact_side)
    # An instant below 2**-50 is nearer to zero than to any such fraction.
    return F.when(F.abs(away) > 1e-5, sign).when(sec < 2.0**-50, F.when(half == 0, F.lit(0)).otherwise(sign)).when(itself, F.lit(0)).otherwise(exact)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """A column over named values that are worked out once each, however often the body uses them."""
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(bound), body), 1)


def _exact_side(v: Column) -> Column:
    """`_side` near a half frame, from sec, half, two (twice the rate's numerator) and den."""
    shift = (F.lit(61) - F.floor(F.log2(v["sec"]))).cast("int")
    one = F.lit(1).cast("bigint")

    def scaled(s: Column) -> Column:
        power = _whole(F.call_function("shiftleft", one, F.least(s["shift"], F.lit(62))), 19) * _whole(F.call_function("shiftleft", one, F.greatest(s["shift"] - 62, F.lit(0))), 19)
        whole = _whole(_long(v["sec"] * F.pow(F.lit(2.0), s["shift"])), 19)
        top = v["half"] * v["den"]
        return _let({"power": power, "whole": whole, "top": top, "common": _gcd(v["two"], F.pmod(top, v["two"]))}, apart)

    def apart(s: Column) -> Column:
        gap = _whole(s["whole"] * _whole(v["two"], 12)) - _whole(_whole(s["top"], 19) * _whole(s["power"], 38))
        d = _div(v["two"], s["common"])
        return _let({"gap": gap.cast("double"), "d": d, "power": s["power"].cast("double"), "top": _div(s["top"], s["common"])}, reach)

    def reach(s: Column) -> Column:
        ways = F.abs(s["gap"]) * s["d"] / (s["power"] * _div(v["two"], F.lit(2)))
        return _let({"sign": F.signum(s["gap"]).cast("int"), "ways": ways, "d": s["d"], "top": s["top"]}, decided)

    def decided(s: Column) -> Column:
        most = F.lit(MOST_DENOMINATOR).cast("bigint")

        def neighbour(w: Column) -> Column:
            residue = F.when(s["sign"] < 0, w["inverse"]).otherwise(F.pmod(-w["inverse"], s["d"]))
            return s["ways"] * (most - F.pmod(most - residue, s["d"])) < 1

        by_neighbour = _let({"inverse": _inverse(F.pmod(s["top"], s["d"]), s["d"])}, neighbour)
        on_it = F.when(s["ways"] * most < 1, True).when(s["ways"] * (most - s["d"]) >= 1, False).otherwise(by_neighbour)
        return F.when((s["sign"] == 0) | on_it, F.lit(0)).otherwise(s["sign"])

    return _let({"shift": shift}, scaled)


def to_frames(sec: Column, num: Column, den: Column, mode: str = "round") -> Column:
    """Frame number of an instant: "round" (half up), "floor" or "ceil", as in exact fractions.

    Seconds stored as doubles stand for the closest fraction with a denominator up to a thousand
    million, so instants on a frame or half way between two are found as such. Negative seconds are an error.
    """
    if mode not in ("round", "floor", "ceil"):
        raise ValueError(f"unknown rounding mode {mode!r}")
    sec = sec.cast("double")
    half = _long(F.floor(sec * (_long(num) * 2) / den + 0.5))
    side = _side(sec, half, num, den)
    odd = F.pmod(half, F.lit(2)) == 1
    low = _div(half, F.lit(2))
    frame = {
        "round": F.when(odd & (side >= 0), low + 1).otherwise(low),
        "floor": F.when(~odd & (side < 0), low - 1).otherwise(low),
        "ceil": F.when(odd | (side > 0), low + 1).otherwise(low),
    }[mode]
    return F.when(sec < 0, _long(F.raise_error(F.lit("time must not be negative")))).otherwise(_long(frame))


def to_seconds(frames: Column, num: Column, den: Column) -> Column:
    return _long(frames) * _long(den) / _long(num)


def duration_frames(start: Column, duration: Column, num: Column, den: Column) -> Column:
    """Frames from the start frame to the end frame, so neighbours meet without a gap; at least one."""
    return F.greatest(
        _long(F.lit(1)), to_frames(start + duration, num, den) - to_frames(start, num, den)
    )


def rebased_duration(target_frames: Column, num: Column, den: Column, target_num: Column, target_den: Column) -> Column:
    """Fewest source frames (rate num/den) that cover a number of target frames; at least one."""
    top = _long(target_frames) * _long(num) * _long(target_den)
    bottom = _long(den) * _long(target_num)
    return F.greatest(_long(F.lit(1)), _div(top + bottom - 1, bottom))


def rebase(frames: Column, num: Column, den: Column, target_num: Column, target_den: Column) -> Column:
    """Frame number on another rate at the same instant (half up), in integers."""
    top = _long(frames) * _long(den) * _long(target_num)
    bottom = _long(num) * _long(target_den)
    return _div(top * 2 + bottom, bottom * 2)


def nominal_fps(num: Column, den: Column) -> Column:
    """Whole frames per second used for labels: 24 for 24000/1001."""
    return F.when(_long(den) == 1001, _long(F.bround(num / den))).otherwise(F.floor(num / den).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", _long(a), _long(b))


def timecode(frames: Column, num: Column, den: Column, drop_frame: Column | None = None) -> Column:
    """HH:MM:SS:FF label; drop-frame labels use ';' and skip 2 or 4 numbers a minute, except every tenth."""
    fps = nominal_fps(num, den)
    n = _long(frames)
    drop_frame = F.lit(False) if drop_frame is None else drop_frame
    drop = F.when(_long(num) == 30000, F.lit(2)).otherwise(F.lit(4)).cast("bigint")
    per_minute, per_ten = fps * 60 - drop, fps * 600 - drop * 9
    tens, rest = _div(n, per_ten), F.pmod(n, per_ten)
    rest = F.when(rest < drop, rest + drop).otherwise(rest)
    label = F.when(drop_frame, n + drop * 9 * tens + drop * _div(rest - drop, per_minute)).otherwise(n)
    total = _div(label, fps)
    mark = F.when(drop_frame, F.lit(";")).otherwise(F.lit(":"))
    return F.concat(
        F.format_string("%02d:%02d:%02d", _div(total, F.lit(3600)), F.pmod(_div(total, F.lit(60)), F.lit(60)), F.pmod(total, F.lit(60))),
        mark,
        F.format_string("%02d", F.pmod(label, fps)),
    )


def is_drop_rate(num: Column, den: Column) -> Column:
    return (_long(den) == 1001) & _long(num).isin(30000, 60000)


def best_fraction(value: Column, max_den: int) -> Column:
    """Closest fraction with a bounded denominator, as struct(num, den), by continued fractions."""
    big = "bigint"

    def state(p0, q0, p1, q1, x, done, exact):
        return F.struct(
            p0.cast(big).alias("p0"), q0.cast(big).alias("q0"), p1.cast(big).alias("p1"), q1.cast(big).alias("q1"),
            x.alias("x"), done.alias("done"), exact.alias("exact"),
        )

    start = state(F.lit(0), F.lit(1), F.lit(1), F.lit(0), value.cast("double"), F.lit(False), F.lit(False))

    def step(s, _):
        whole = _long(F.floor(s["x"]))
        q2 = s["q0"] + whole * s["q1"]
        rest = s["x"] - whole
        exact = rest < 1e-9
        following = state(
            s["p1"], s["q1"], s["p0"] + whole * s["p1"], q2,
            F.when(exact, F.lit(0.0)).otherwise(F.lit(1.0) / F.when(exact, F.lit(1.0)).otherwise(rest)), exact, exact,
        )
        stop = state(s["p0"], s["q0"], s["p1"], s["q1"], s["x"], F.lit(True), s["exact"])
        return F.when(s["done"], s).when(q2 > max_den, stop).otherwise(following)

    def finish(s):
        k = _div(F.lit(max_den) - s["q0"], F.when(s["q1"] > 0, s["q1"]).otherwise(F.lit(1)))
        p, q = s["p0"] + k * s["p1"], s["q0"] + k * s["q1"]
        direct = F.abs(s["p1"] / F.when(s["q1"] > 0, s["q1"]) - value)
        other = F.abs(p / F.when(q > 0, q) - value)
        keep = s["exact"] | (direct <= other)
        return F.struct(F.when(keep, s["p1"]).otherwise(p).alias("num"), F.when(keep, s["q1"]).otherwise(q).alias("den"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step, finish)


def normalise_fps(fps: Column) -> Column:
    """Rational form of a decimal frame rate, as struct(num, den)."""
    exact = F.struct(_long(fps).alias("num"), _long(F.lit(1)).alias("den"))
    out = F.when(fps == F.floor(fps), exact)
    for spelled, (num, den) in BROADCAST_RATES.items():
        out = out.when(F.bround(fps, 3) == spelled, F.struct(_long(F.lit(num)).alias("num"), _long(F.lit(den)).alias("den")))
    return out.otherwise(best_fraction(fps, 100_000))


def catalog_fps(fps: Column) -> Column:
    """Rational form of a catalogued rate: 24000/1001 when absent, denominators up to 1001."""
    missing = F.struct(_long(F.lit(24000)).alias("num"), _long(F.lit(1001)).alias("den"))
    return F.when(fps.isNull() | (fps == 0), missing).otherwise(best_fraction(fps, 1001))
