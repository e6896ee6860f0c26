"""Values around a time: the nearest event before or after, and all events in an interval.

Events and the times to look up are put into one frame, ordered by person and time, and a window hands the
last event on to the times behind it. One shuffle does it, whatever the number of events per person.
Of events at one time only one can be the nearest, so these are reduced in the map tasks first; equal times to look up are looked up once.

A person with a large share of the rows is cut into pieces of time, each a window of its own. What a piece has
to know of the pieces before is their last event: a few rows, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .skew import Hot, as_list, hot_keys, hot_rows, skew_join

_TIME, _PIECE, _EVENT, _SIDE, _SALTS = "__t", "__piece", "__event", "__side", "__salts"
DIRECTIONS = ("before", "after", "nearest")


def gap_within(gap: Column, kind: T.DataType, most: float) -> Column:
    """Whether a difference of two times is at most `most`: seconds, or units of a numeric time."""
    limit = F.lit(most) if isinstance(kind, T.NumericType) else F.make_dt_interval(secs=F.lit(float(most)))
    return gap <= limit


def _pieces(times: DataFrame, on: list[str], hot: Hot) -> DataFrame:
    """For each hot key the times at which its pieces begin; at most one row per hot key."""
    n = max(hot.values())
    shares = [i / n for i in range(1, n)] or [0.5]
    found = hot_rows(times, on, hot, _SALTS).filter(F.col(_SALTS).isNotNull())
    return found.groupBy(*on).agg(F.percentile_approx(_TIME, shares, max(10_000, 20 * n)).alias("__bounds"))


def _cut(df: DataFrame, on: list[str], pieces: DataFrame | None) -> DataFrame:
    """`df` with the number of its piece; rows at one time are in one piece."""
    if pieces is None:
        return df.withColumn(_PIECE, F.lit(0))
    cut = df.join(F.broadcast(pieces), on, "left")
    begun = F.size(F.filter("__bounds", lambda b: b <= F.col(_TIME)))
    return cut.withColumn(_PIECE, F.when(F.col("__bounds").isNull(), 0).otherwise(begun)).drop("__bounds")


def _looked_up(
    times: DataFrame, events: DataFrame, on: list[str], pieces: DataFrame | None, rank: Column, before: bool, same_time: bool
) -> DataFrame:
    """(keys, time, event) for all `times`: the last event up to it, or the first from it on."""
    pick = F.max_by if before else F.min_by
    one = events.groupBy(*on, _TIME).agg(pick(_EVENT, rank).alias(_EVENT))
    if pieces is not None:
        one = written(one, "events-at-a-time")
    one = _cut(one, on, pieces)
    # at one time events count as earlier if they may be at the very time
    sides = [
        one.select(*on, _TIME, _PIECE, _EVENT, F.lit(not same_time).alias(_SIDE)),
        _cut(times, on, pieces).select(*on, _TIME, _PIECE, F.lit(None).cast(one.schema[_EVENT].dataType).alias(_EVENT), F.lit(same_time).alias(_SIDE)),
    ]
    order = F.asc(_TIME) if before else F.desc(_TIME)
    upto = Window.partitionBy(*on, _PIECE).orderBy(order, F.asc(_SIDE)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = sides[0].union(sides[1]).withColumn("__found", F.last(_EVENT, ignorenulls=True).over(upto))
    found = found.filter(F.col(_SIDE) == same_time)
    if pieces is not None:
        # of each piece of a hot key the event next to the following (preceding) pieces
        ends = one.join(F.broadcast(pieces.select(*on)), on).groupBy(*on, _PIECE).agg(pick(_EVENT, _TIME).alias("e"))
        listed = ends.groupBy(*on).agg(F.collect_list(F.struct(F.col(_PIECE).alias("piece"), "e")).alias("__ends"))
        found = found.join(F.broadcast(listed), on, "left")
        other = F.filter("__ends", lambda x: x["piece"] < F.col(_PIECE) if before else x["piece"] > F.col(_PIECE))
        nearest = F.array_sort(other, lambda x, y: (y["piece"] - x["piece"] if before else x["piece"] - y["piece"]))
        found = found.withColumn("__found", F.coalesce("__found", F.get(nearest, F.lit(0))["e"]))
    return found.select(*on, _TIME, F.col("__found").alias(_EVENT))


def as_of(
    index: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    *,
    index_time: str,
    event_time: str,
    direction: str = "before",
    order: Sequence[str] = (),
    same_time: bool = True,
    within: float | None = None,
    suffix: str = "_event",
    hot: Hot | None = None,
) -> DataFrame:
    """Every row of `index` with the columns of the nearest event of its key (names get `suffix`), NULL without one.

    `direction` is before, after or nearest (the earlier one of two equally near). `same_time` lets an event at the very
    time count. `within` is the largest distance allowed: seconds, or units of a numeric time. Events at one time are told
    apart by `order` (by default by all their columns): the last of them counts before, the first after. Events without key or time are not
    considered; index rows without them stay, without an event.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    on = as_list(on)
    values = [c for c in events.columns if c not in on]
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    lean = events.dropna(subset=[*on, event_time]).select(*on, F.col(event_time).alias(_TIME), row.alias(_EVENT))
    kind = events.schema[event_time].dataType
    times = index.dropna(subset=[*on, index_time]).select(*on, F.col(index_time).cast(kind).alias(_TIME)).distinct()
    both = lean.select(*on, _TIME).union(times)
    if hot is None:
        hot = hot_keys(both, on)
    pieces = written(_pieces(both, on, hot), "pieces-of-time") if hot else None
    rank = F.struct(*[F.col(f"{_EVENT}.`{c}`") for c in order]) if order else F.col(_EVENT)

    def side(before: bool) -> DataFrame:
        return _looked_up(times, lean, on, pieces, rank, before, same_time)

    if direction == "nearest":
        ends = side(True).withColumnRenamed(_EVENT, "__left").join(side(False).withColumnRenamed(_EVENT, "__right"), [*on, _TIME])
        left, right = F.col(f"__left.`{event_time}`"), F.col(f"__right.`{event_time}`")
        earlier = F.col("__right").isNull() | (F.col(_TIME) - left <= right - F.col(_TIME))
        found = ends.withColumn(_EVENT, F.when(earlier & F.col("__left").isNotNull(), F.col("__left")).otherwise(F.col("__right")))
    else:
        found = side(direction == "before")
    if within is not None:
        at = F.col(f"{_EVENT}.`{event_time}`")
        near = gap_within(F.when(at <= F.col(_TIME), F.col(_TIME) - at).otherwise(at - F.col(_TIME)), kind, within)
        found = found.withColumn(_EVENT, F.when(near, F.col(_EVENT)))
    found = found.select(*on, _TIME, _EVENT)
    timed = index.withColumn(_TIME, F.col(index_time).cast(kind))
    joined = skew_join(timed, found, [*on, _TIME], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in index.columns], *[F.col(f"{_EVENT}.`{c}`").alias(c + suffix) for c in values]
    )


def events_within(
    index: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    *,
    index_time: str,
    event_time: str,
    before: float = 0,
    after: float = 0,
    suffix: str = "_event",
) -> DataFrame:
    """Pairs of index rows and events of their key that lie up to `before` seconds earlier or `after` seconds later.

    Days are put into bins as wide as the interval, so that an index row meets the events of two or three bins and
    not all of its key; bins with many events are spread.
    """
    on = as_list(on)
    width = max(1, -(-int(before + after) // 86_400))
    values = [c for c in events.columns if c not in on]

    def bin_of(time: Column) -> Column:
        return F.floor(F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")) / width).cast("int")

    at = F.col(index_time)
    low, high = at - F.make_dt_interval(secs=F.lit(float(before))), at + F.make_dt_interval(secs=F.lit(float(after)))
    starts = index.dropna(subset=[*on, index_time]).withColumns({"__low": low, "__high": high})
    starts = starts.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__low")), bin_of(F.col("__high")))))
    renamed = events.dropna(subset=[*on, event_time]).select(
        *on, bin_of(F.col(event_time)).alias("__bin"), *[F.col(f"`{c}`").alias(c + suffix) for c in values]
    )
    time = F.col(f"`{event_time}{suffix}`")
    pairs = skew_join(renamed, starts, [*on, "__bin"]).filter((time >= F.col("__low")) & (time <= F.col("__high")))
    return pairs.select(*[F.col(f"`{c}`") for c in index.columns], *[F.col(f"`{c}{suffix}`") for c in values])
