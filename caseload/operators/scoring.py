"""Priority score, tier (X1-X3) and distributed sequential numbering."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import size_bonus, sql_literal, tier, weighted_sum


def score(df: DataFrame, weights=S.WEIGHTS, bonus=S.SIZE_BONUS, tiers=S.TIERS, size_col: str = "family_size") -> DataFrame:
    """Add ``priority_score`` (weights of true signals + size bonus) and ``priority_tier``."""
    size = F.col(size_col) if size_col in df.columns else F.lit(None)
    points = (weighted_sum(weights, df.columns) + size_bonus(size, bonus)).cast("bigint")
    return df.withColumn("priority_score", points).withColumn("priority_tier", tier(F.col("priority_score"), tiers))


_ID_BITS = 33  # monotonically_increasing_id(): partition index in the upper 31 bits, row index in the lower 33
#: Sampled places per range: the ranges' sizes then differ by little (about an eighth).
OVERSAMPLE = 64
#: Rows of a range, up to the session's number of shuffle partitions.
RANGE_ROWS = 1 << 16
_STEP = 32  # splitters per step of the two-step search


def _placed(df: DataFrame, order_by: str | list[str], tie: list[str] | None) -> DataFrame:
    """``df`` with ``_place``: the order key (null last), then a hash of ``tie`` (by default of all columns)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    tie = [f"`{c}`" for c in (df.columns if tie is None else tie)]
    parts = []
    for i, k in enumerate(keys):
        parts += [F.col(f"`{k}`").isNull().alias(f"n{i}"), F.col(f"`{k}`").alias(f"k{i}")]
    return df.withColumn("_place", F.struct(*parts, (F.xxhash64(*tie) if tie else F.lit(0)).alias("tb")))


def _splitters(places: DataFrame, rows: int, ranges: int) -> list[tuple]:
    """The places that split the rows into about equal ranges, ascending (fewer than ``ranges``).

    A quantile sketch: places whose hash is below a bound, about ``OVERSAMPLE * ranges`` of them and each once, so
    neither a large table nor a hot place makes it larger. The splitters reach the driver, the sample does not.
    """
    if ranges == 1:
        return []
    bound = OVERSAMPLE * ranges / rows * (1 << 31)
    sample = places.where(F.pmod(F.xxhash64("_place"), F.lit(1 << 31)) < F.lit(bound))
    found = sample.agg(F.array_sort(F.collect_set("_place")).alias("s"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)),
                         lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / F.lit(ranges)).cast("int")))
    first = found.select(F.when(F.size("s") > 0, F.array_distinct(picked)).alias("s")).first()
    return list(first.s or [])


def _literal(places: list[tuple], place_type: str) -> Column:
    """An array literal of places (one expression, folded to a constant)."""
    rows = ", ".join("struct(" + ", ".join(sql_literal(v) for v in place) + ")" for place in places)
    return F.expr(f"CAST(array({rows}) AS array<{place_type}>)")


def _range_of(place: Column, splitters: Column) -> Column:
    """How many of the ascending splitters are not above the place, by a search in two steps."""
    steps = F.filter(splitters, lambda s, i: i % _STEP == _STEP - 1)
    step = F.size(F.filter(steps, lambda s: s <= place))
    within = F.slice(splitters, step * _STEP + 1, _STEP)
    return (step * _STEP + F.size(F.filter(within, lambda s: s <= place))).cast("int")


def _ranged(df: DataFrame, order_by: str | list[str], num_partitions: int | None, tie: list[str] | None) -> tuple[DataFrame, int]:
    """``df`` with ``_place`` and its range ``_part``, and the number of ranges: ``num_partitions``, or one for every
    ``RANGE_ROWS`` rows up to the session's shuffle partitions (a small batch is written as a few files)."""
    placed = _placed(df, order_by, tie)
    places = placed.select("_place")
    rows = places.count()
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (num_partitions or min(most, -(-rows // RANGE_ROWS))) if rows else 1
    splitters = _literal(_splitters(places, rows, ranges), dict(placed.dtypes)["_place"])
    return placed.withColumn("_part", _range_of(F.col("_place"), splitters)), ranges


def range_tagged(df: DataFrame, order_by: str | list[str], num_partitions: int | None = None,
                 tie: list[str] | None = None) -> DataFrame:
    """Range-partition on (order key, row hash), sort within partitions and tag each row with ``_rid``.

    ``_rid >> 33`` is the range partition, the low 33 bits the position in it.
    """
    ranged, ranges = _ranged(df, order_by, num_partitions, tie)
    return _tagged(ranged, ranges).drop("_part")


def _tagged(ranged: DataFrame, ranges: int) -> DataFrame:
    return (
        ranged
        .repartitionById(ranges, F.col("_part"))
        .sortWithinPartitions("_place")
        .withColumn("_rid", F.monotonically_increasing_id())
        .drop("_place")
    )


def number_cases(df: DataFrame, order_by: str | list[str] = "family_id", start=1, name: str = "family_num",
                 num_partitions: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order_by`` order without a single-task window and without a scratch table.

    1. Splitters from a quantile sketch of the place (order key, row hash): the hash splits a
       hot key across ranges, so no task receives more than its share even for duplicate keys.
    2. Rows per range, summed up to the ranges' offsets (one number per range).
    3. One pass over the wide rows: they go to their range's partition, are sorted there, and
       their number is offset + position.

    Steps 1 and 2 run at once and read only the columns of the place. ``tie`` names the columns of the row hash
    (default: all); with columns that come from one input table, the joins that produce the others are dropped
    from steps 1 and 2. Rows equal in all of these may swap their numbers. ``df`` is evaluated more than
    once, so it must give the same rows each time (stored tables and deterministic steps on them do).
    ``start`` may be a column expression (e.g. max existing number + 1).
    """
    ranged, ranges = _ranged(df, order_by, num_partitions, tie)
    counted = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) if ranges > 1 else None
    sizes = dict(counted.collect()) if counted else {}  # one row per range
    offsets = [0, *accumulate(sizes.get(part, 0) for part in range(ranges - 1))]
    offset = F.get(F.expr(f"array({', '.join(f'{n}L' for n in offsets)})"), F.col("_part"))
    position = F.col("_rid") - F.shiftleft(F.shiftright(F.col("_rid"), _ID_BITS), _ID_BITS)
    first = start if isinstance(start, Column) else F.lit(start)
    numbered = _tagged(ranged, ranges).withColumn(name, (offset + position + first).cast("bigint"))
    return numbered.drop("_rid", "_part")
