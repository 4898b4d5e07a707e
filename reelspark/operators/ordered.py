"""Ordered computations per key that stay parallel when one key holds most of the rows.

A window partitioned by the key alone puts a hot key into one task. Here each key's rows are cut
into slices of its order column; windows run per (key, slice), and what crosses a slice border is
carried by one summary row per slice.

* `Sliced` sizes slices from each key's own count and range (event times, values).
* `with_halo` uses fixed slices of a dense integer index and copies the few rows next to a border
  into the neighbouring slice, so moving frames need no summary.

Only keys above `ROWS_PER_SLICE` rows are cut. There are at most rows / ROWS_PER_SLICE of them, and
at most twice as many slices, which bounds the two broadcast tables. Whether a hot key exists is
counted first; without one the plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspark.session import freed_shuffles, materialise

ROWS_PER_SLICE = 2_000_000


@dataclass(frozen=True)
class Ask:
    """One ordered column to add: what to compute and from which expression."""

    kind: str
    expr: Column | None = None
    default: Column | None = None


def position() -> Ask:
    """Zero-based rank of the row within its key."""
    return Ask("position")


def running_sum(expr: Column) -> Ask:
    """Sum over the rows up to and including this one."""
    return Ask("sum_to", expr)


def sum_before(expr: Column) -> Ask:
    """Sum over the rows strictly before this one (zero for the first)."""
    return Ask("sum_before", expr)


def max_before(expr: Column) -> Ask:
    """Largest value over the rows strictly before this one (null for the first)."""
    return Ask("max_before", expr)


def previous(expr: Column) -> Ask:
    """Last non-null value strictly before this row."""
    return Ask("previous", expr)


def following(expr: Column) -> Ask:
    """First non-null value strictly after this row."""
    return Ask("following", expr)


def lag(expr: Column, default: Column | None = None) -> Ask:
    """Value of the row before, null or not."""
    return Ask("lag", expr, default)


def lead(expr: Column, default: Column | None = None) -> Ask:
    """Value of the row after, null or not."""
    return Ask("lead", expr, default)


def key_total(expr: Column) -> Ask:
    """Sum over the whole key, repeated on each row."""
    return Ask("total", expr)


class ExactSum:
    """A sum of doubles whose result does not depend on the order or grouping of the rows.

    A value is split into whole numbers of its integer part and of two times thirty bits after the point; their sums are
    exact, and only the last step rounds. What lies below 2**-60 is left off each value alone. Values that are not finite
    or of 2**52 and more are summed as doubles beside them.
    """

    PARTS = ("whole", "high", "low", "rest")

    @staticmethod
    def split(x: Column) -> list[Column]:
        """The four parts of a value; null for null."""
        plain = F.abs(x) < 2.0**52
        whole = F.floor(x)
        first = (x - whole) * 2.0**30
        second = (first - F.floor(first)) * 2.0**30
        parts = [F.when(plain, p).when(x.isNotNull(), F.lit(0).cast("long")) for p in (whole, F.floor(first), F.floor(second))]
        return [*parts, F.when(x.isNotNull() & ~plain, x)]

    @staticmethod
    def joined(whole: Column, high: Column, low: Column, rest: Column) -> Column:
        """The double closest to the summed parts."""
        mask, bits = F.lit((1 << 30) - 1), 30
        high = high + F.shiftright(low, bits)
        whole = whole + F.shiftright(high, bits)
        fraction = high.bitwiseAND(mask).cast("double") * 2.0**-30 + low.bitwiseAND(mask).cast("double") * 2.0**-60
        return whole.cast("double") + fraction + F.coalesce(rest, F.lit(0.0))


_SUMS = ("sum_to", "sum_before", "total")


# Outcome of earlier counts by plan and size of its input, so a table that has grown is counted again.
_COUNTED: dict[tuple, bool] = {}


def _any_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], rows_per_slice: int) -> bool:
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    seen = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), size, tuple(keys), rows_per_slice)
    if seen not in _COUNTED:
        with freed_shuffles(df.sparkSession):
            _COUNTED[seen] = not hot.isEmpty()
    return _COUNTED[seen]


# Most pieces of a key, and of a slice that is cut again; three more cuts still fit a 64-bit number.
_FIRST = 1 << 16
_SUB = 1 << 15


def _piece(axis: Column, low: str, high: str, pieces: str) -> Column:
    """Equal-width piece, from zero, that holds a value."""
    at = F.floor((axis - F.col(low)) / (F.col(high) - F.col(low)) * F.col(pieces)).cast("bigint")
    return F.least(F.col(pieces) - 1, at)


class Sliced:
    """Rows of `df` ready for ordered columns and per-key lookups, sliced only when some key is hot.

    Building one runs a count per key. Without a hot key the plan stays a plain window over the key.
    With one, the sliced rows are written once, so the window pass and the carry pass read one copy.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int | None = None):
        self.keys = list(keys)
        self.order = list(order)
        rows_per_slice = rows_per_slice or ROWS_PER_SLICE
        axis = F.col(self.order[0]).cast("double")
        stats = df.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("_rows"), F.min(axis).alias("_lo"), F.max(axis).alias("_hi")
        )
        hot = stats.where(F.col("_rows") > rows_per_slice).select(
            *self.keys, "_lo", "_hi",
            F.least(F.ceil(F.col("_rows") / F.lit(rows_per_slice)).cast("bigint"), F.lit(_FIRST)).alias("_pieces"),
        )
        self.hot = None
        self.parts = self.keys
        self.rows = df
        if not _any_hot(df, hot, self.keys, rows_per_slice):
            return
        self.parts = [*self.keys, "_slice"]
        # At most rows / rows_per_slice hot keys exist, so this broadcast is bounded.
        joined = df.join(F.broadcast(materialise(hot, "hot-keys")), self.keys, "left")
        cut = F.when(F.col("_hi") > F.col("_lo"), _piece(axis, "_lo", "_hi", "_pieces"))
        rows = joined.withColumns({"_slice": F.coalesce(cut, F.lit(0).cast("bigint")), "_hot": F.col("_pieces").isNotNull()})
        rows = self._refine(materialise(rows.drop("_lo", "_hi", "_pieces"), "sliced"), rows_per_slice)
        # Slices of hot keys: a few per rows_per_slice rows, so bounded like the hot keys.
        self.hot = materialise(rows.where("_hot").select(*self.parts).distinct(), "slices")
        # A stated shuffle: an input already hashed by the key alone would satisfy the windows
        # below and leave a hot key in one task.
        self.rows = rows.repartition(*[F.col(c) for c in self.parts])

    def _refine(self, rows: DataFrame, rows_per_slice: int, rounds: int = 3) -> DataFrame:
        """Cut slices that a burst left too large again, by the next order column where the first is constant."""
        first = F.col(self.order[0]).cast("double")
        second = F.col(self.order[1]).cast("double") if len(self.order) > 1 else F.lit(0.0)
        for _ in range(rounds):
            stats = rows.where("_hot").groupBy(*self.parts).agg(
                F.count(F.lit(1)).alias("_rows"), F.min(first).alias("_lo1"), F.max(first).alias("_hi1"), F.min(second).alias("_lo2"), F.max(second).alias("_hi2")
            )
            large = stats.where((F.col("_rows") > 2 * rows_per_slice) & ((F.col("_hi1") > F.col("_lo1")) | (F.col("_hi2") > F.col("_lo2"))))
            pieces = F.least(F.ceil(F.col("_rows") / F.lit(rows_per_slice)).cast("bigint"), F.lit(_SUB - 1))
            large = large.select(*self.parts, "_lo1", "_hi1", "_lo2", "_hi2", pieces.alias("_pieces"))
            if large.isEmpty():
                break
            joined = rows.join(F.broadcast(materialise(large, "large-slices")), self.parts, "left")
            sub = F.when(F.col("_hi1") > F.col("_lo1"), _piece(first, "_lo1", "_hi1", "_pieces")).when(
                F.col("_hi2") > F.col("_lo2"), _piece(second, "_lo2", "_hi2", "_pieces")
            )
            renumbered = F.col("_slice") * _SUB + F.coalesce(sub, F.lit(0).cast("bigint"))
            rows = joined.withColumn("_slice", F.when(F.col("_hot"), renumbered).otherwise(F.col("_slice")))
            rows = rows.drop("_lo1", "_hi1", "_lo2", "_hi2", "_pieces")
        return rows

    def attach(self, per_key: DataFrame, how: str = "left") -> "Sliced":
        """Join one row per key onto every slice of that key."""
        if self.hot is None:
            self.rows = self.rows.join(per_key, self.keys, how)
            return self
        copies = per_key.join(F.broadcast(self.hot), self.keys, "left")
        copies = copies.withColumn("_slice", F.coalesce("_slice", F.lit(0).cast("bigint")))
        self.rows = self.rows.join(copies, self.parts, how)
        return self

    def with_columns(self, columns: Mapping[str, Column]) -> "Sliced":
        self.rows = self.rows.withColumns(dict(columns))
        return self

    def annotate(self, asks: Mapping[str, Ask]) -> "Sliced":
        """Add ordered columns. Sums of doubles are exact (`ExactSum`), so slicing changes no bit of them."""
        sums = {n: a for n, a in asks.items() if a.kind in _SUMS}
        kinds = self.rows.select(*[a.expr.alias(n) for n, a in sums.items()]).schema if sums else []
        doubles = [f.name for f in kinds if f.dataType.typeName() in ("double", "float")]
        if not doubles:
            return self._annotate(asks)
        split, parts = {}, {}
        for name in asks:
            if name in doubles:
                for part, column in zip(ExactSum.PARTS, ExactSum.split(asks[name].expr.cast("double"))):
                    split[f"_p_{name}_{part}"] = column
                    parts[f"_q_{name}_{part}"] = Ask(asks[name].kind, F.col(f"_p_{name}_{part}"))
            else:
                parts[name] = asks[name]
        out = self.with_columns(split)._annotate(parts)
        for name in doubles:
            out = out.with_columns({name: ExactSum.joined(*[F.col(f"_q_{name}_{p}") for p in ExactSum.PARTS])})
        out.rows = out.rows.drop(*split, *[c for c in parts if c.startswith("_q_")])
        return out

    def _annotate(self, asks: Mapping[str, Ask]) -> "Sliced":
        part = Window.partitionBy(*self.parts)
        up = part.orderBy(*[F.col(c).asc() for c in self.order])
        down = part.orderBy(*[F.col(c).desc() for c in self.order])
        before = up.rowsBetween(Window.unboundedPreceding, -1)
        stamp = F.struct(*[F.col(c) for c in self.order])

        held, local, summary = {}, {}, {}
        for name, ask in asks.items():
            src = F.col(f"_e_{name}")
            if ask.kind == "position":
                local[name] = (F.row_number().over(up) - 1).cast("bigint")
                summary[name] = F.count(F.lit(1)).alias(f"_c_{name}")
                continue
            expr = F.struct(ask.expr.alias("v")) if ask.kind in ("lag", "lead") else ask.expr
            held[f"_e_{name}"] = expr
            if ask.kind == "sum_to":
                local[name] = F.sum(src).over(up.rowsBetween(Window.unboundedPreceding, 0))
                summary[name] = F.sum(src)
            elif ask.kind == "sum_before":
                local[name] = F.coalesce(F.sum(src).over(before), F.lit(0))
                summary[name] = F.sum(src)
            elif ask.kind == "max_before":
                local[name] = F.max(src).over(before)
                summary[name] = F.max(src)
            elif ask.kind == "total":
                local[name] = F.sum(src).over(part)
                summary[name] = F.sum(src)
            elif ask.kind in ("previous", "lag"):
                local[name] = F.lag(src).over(up) if ask.kind == "lag" else F.last(src, ignorenulls=True).over(before)
                summary[name] = F.max_by(src, F.when(src.isNotNull(), stamp))
            elif ask.kind in ("following", "lead"):
                # A descending frame keeps "next known" linear; a frame open to the end is quadratic.
                ahead = down.rowsBetween(Window.unboundedPreceding, -1)
                local[name] = F.lead(src).over(up) if ask.kind == "lead" else F.last(src, ignorenulls=True).over(ahead)
                summary[name] = F.min_by(src, F.when(src.isNotNull(), stamp))
            else:
                raise ValueError(f"unknown ordered column kind: {ask.kind}")

        rows = self.rows.withColumns(held) if held else self.rows
        carried = None
        if self.hot is not None:
            carried = self._carry(rows.where("_hot"), asks, summary)
        rows = rows.withColumns(local)
        if carried is not None:
            rows = rows.join(F.broadcast(carried), self.parts, "left")
        for name, ask in asks.items():
            carry = F.lit(None) if carried is None else F.col(f"_c_{name}")
            if carried is None:
                value = F.col(name)
            elif ask.kind in ("position", "sum_to", "sum_before"):
                value = F.when(F.col(name).isNull(), carry).otherwise(F.col(name) + F.coalesce(carry, F.lit(0)))
            elif ask.kind == "max_before":
                value = F.greatest(F.col(name), carry)
            elif ask.kind == "total":
                value = F.coalesce(carry, F.col(name))
            else:
                value = F.coalesce(F.col(name), carry)
            if ask.kind in ("lag", "lead"):
                # Only a missing neighbour takes the default, not a neighbour holding null.
                value = value["v"] if ask.default is None else F.when(value.isNull(), ask.default).otherwise(value["v"])
            rows = rows.withColumn(name, value)
        self.rows = rows.drop(*held, *[f"_c_{n}" for n in asks])
        return self

    def _carry(self, hot_rows: DataFrame, asks: Mapping[str, Ask], summary: Mapping[str, Column]) -> DataFrame:
        per_slice = hot_rows.groupBy(*self.keys, "_slice").agg(*[c.alias(f"_s_{n}") for n, c in summary.items()])
        key = Window.partitionBy(*self.keys)
        earlier = key.orderBy(F.col("_slice").asc()).rowsBetween(Window.unboundedPreceding, -1)
        later = key.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        out = []
        for name, ask in asks.items():
            src = F.col(f"_s_{name}")
            if ask.kind in ("position", "sum_to", "sum_before"):
                value = F.sum(src).over(earlier)
            elif ask.kind == "max_before":
                value = F.max(src).over(earlier)
            elif ask.kind == "total":
                value = F.sum(src).over(key)
            elif ask.kind in ("previous", "lag"):
                value = F.last(src, ignorenulls=True).over(earlier)
            else:
                value = F.last(src, ignorenulls=True).over(later)
            out.append(value.alias(f"_c_{name}"))
        return per_slice.select(*self.keys, "_slice", *out)

    def df(self) -> DataFrame:
        return self.rows.drop("_slice", "_hot")


def annotate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], asks: Mapping[str, Ask], rows_per_slice: int | None = None
) -> DataFrame:
    """Add ordered columns to `df`; `order` must be numeric in its first column and unique per key."""
    return Sliced(df, keys, order, rows_per_slice).annotate(asks).df()


def attach(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: str, how: str = "left", rows_per_slice: int | None = None
) -> DataFrame:
    """Join one row per key onto `df`, spreading a hot key by the numeric column `spread`."""
    return Sliced(df, keys, [spread], rows_per_slice).attach(per_key, how).df()


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    before: int,
    after: int,
    *columns: Callable[[object], Mapping[str, Column]],
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add moving-window columns over a dense integer index.

    Each of `columns` receives the window (partitioned by key and slice, ordered by index) and returns
    columns to add; later ones may use earlier ones. Together they may look no further than `before`
    rows back and `after` rows ahead.
    """
    size = F.lit(rows_per_slice or ROWS_PER_SLICE)
    own = F.floor(F.col(index) / size).cast("bigint")
    copies = F.array_compact(
        F.array(
            own,
            F.when(F.col(index) >= (own + 1) * size - before, own + 1),
            F.when((own > 0) & (F.col(index) < own * size + after), own - 1),
        )
    )
    rows = df.withColumn("_home", own).withColumn("_slice", F.explode(copies))
    rows = rows.repartition(*[F.col(c) for c in (*keys, "_slice")])
    window = Window.partitionBy(*keys, "_slice").orderBy(index)
    for step in columns:
        rows = rows.withColumns(dict(step(window)))
    return rows.where(F.col("_slice") == F.col("_home")).drop("_slice", "_home")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, float | str], rows_per_slice: int | None = None
) -> DataFrame:
    """Exact quantiles per key, one row per key and one column per entry of `ranks`.

    A float is a linearly interpolated quantile; "upper_median" is the element at n div 2. Equal
    values are counted before the sort, so ties shrink on the map side and nothing holds a whole
    key in memory.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = annotate(
        counted, keys, ["_v"], {"_from": sum_before(F.col("_n")), "_total": key_total(F.col("_n"))}, rows_per_slice
    )

    def low(rank):
        if rank == "upper_median":
            return F.floor(F.col("_total") / 2)
        return F.floor(F.lit(float(rank)) * (F.col("_total") - 1))

    def high(rank):
        return low(rank) if rank == "upper_median" else F.ceil(F.lit(float(rank)) * (F.col("_total") - 1))

    def holds(at: Column) -> Column:
        return (at >= F.col("_from")) & (at < F.col("_from") + F.col("_n"))

    wanted = None
    aggs = [F.max("_total").alias("_total")]
    for name, rank in ranks.items():
        for end, at in (("lo", low(rank)), ("hi", high(rank))):
            wanted = holds(at) if wanted is None else wanted | holds(at)
            aggs.append(F.max(F.when(holds(at), F.col("_v"))).alias(f"_{end}_{name}"))
    picked = ranked.where(wanted).groupBy(*keys).agg(*aggs)
    out = []
    for name, rank in ranks.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        if rank == "upper_median":
            out.append(lo.alias(name))
            continue
        at = F.lit(float(rank)) * (F.col("_total") - 1)
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *out)
