"""Merging, collapsing and ordering of detected codes; recognition scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.operators.ordered import any_group_over, group_limit, islands, row_numbers
from assetflow.session import freeze

# Tolerances on normalized centers, and what counts as "has a position".
QR_TOLERANCE, BARCODE_TOLERANCE, ROW_TOLERANCE = 0.05, 0.12, 0.08
POSITION_EPSILON = 0.001

FOLD_LIMIT = 100_000  # rows of one group that may stand in a list


def has_position() -> Column:
    return (F.col("cx") > POSITION_EPSILON) | (F.col("cy") > POSITION_EPSILON)


def detection_bbox(points: DataFrame, keys: list[str]) -> DataFrame:
    """Normalized center of the box around the result points of each detection."""
    box = points.groupBy(*keys, "image_width", "image_height", "offset_x", "offset_y").agg(
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")
    )

    def center(low: str, high: str, offset: str, size: str) -> Column:
        value = F.try_divide(F.col(offset) + (F.col(low) + F.col(high)) / F.lit(2.0), F.col(size))
        return F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))

    return box.select(
        *keys,
        center("x0", "x1", "offset_x", "image_width").alias("cx"),
        center("y0", "y1", "offset_y", "image_height").alias("cy"),
    )


def merge_detections(
    detections: DataFrame,
    keys: list[str],
    order: list[str],
    tolerance: float,
    positionless_match: bool = True,
) -> DataFrame:
    """First seen wins: a detection is dropped when an earlier *kept* one of its group lies
    within ``tolerance`` on both axes.  With ``positionless_match`` a detection without a
    position equals any other of its group.

    The rule is greedy in ``order`` (a total order).  Groups of bounded size are folded in
    one pass; when a group is too big for a task, the same answer comes from rounds
    of grid aggregates (:func:`_merge_rounds`).
    """
    if not any_group_over(detections, keys, min(group_limit(detections), FOLD_LIMIT)):
        return _merge_fold(detections, keys, order, tolerance, positionless_match)
    if not positionless_match:
        return _merge_rounds(detections, keys, order, tolerance)
    # The group's first row decides: without a position it absorbs everything after it;
    # otherwise every row without one is absorbed by it, and only positions compete.
    first = detections.groupBy(*keys).agg(
        F.min_by(F.struct(has_position().alias("p"), *order), F.struct(*order)).alias("_f")
    )
    joined = detections.join(first, keys)
    is_first = F.struct(*order).eqNullSafe(F.struct(*[F.col(f"_f.{o}") for o in order]))
    lone = joined.filter(~F.col("_f.p") & is_first).drop("_f").dropDuplicates([*keys, *order])
    placed = joined.filter(F.col("_f.p") & has_position()).drop("_f")
    return lone.unionByName(_merge_rounds(placed, keys, order, tolerance))


def _merge_fold(rows: DataFrame, keys: list[str], order: list[str], tolerance: float, positionless_match: bool) -> DataFrame:
    """Groups of bounded size, inside the JVM.  Kept centers lie further apart than the
    tolerance in the unit square, which bounds the list each row is held against."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    entry = F.struct(*order, *rest)
    kept_type = f"array<{rows.select(entry.alias('e')).schema['e'].dataType.simpleString()}>"
    placed = lambda r: (r["cx"] > POSITION_EPSILON) | (r["cy"] > POSITION_EPSILON)

    def same(k: Column, row: Column) -> Column:
        near = (F.abs(k["cx"] - row["cx"]) <= tolerance) & (F.abs(k["cy"] - row["cy"]) <= tolerance)
        return near | ~placed(k) | ~placed(row) if positionless_match else near

    def step(kept: Column, row: Column) -> Column:
        return F.when(F.exists(kept, lambda k: same(k, row)), kept).otherwise(F.concat(kept, F.array(row)))

    listed = rows.groupBy(*keys).agg(F.collect_list(entry).cast(kept_type).alias("_all"))
    # the common group of one row needs no walk
    folded = F.when(F.size("_all") == 1, F.col("_all")).otherwise(
        F.aggregate(F.array_sort("_all"), F.array().cast(kept_type), step)
    )
    return listed.select(*keys, F.explode(folded).alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns]
    )


def _merge_rounds(rows: DataFrame, keys: list[str], order: list[str], tolerance: float) -> DataFrame:
    """The greedy answer without gathering a group.

    On a grid of ``tolerance`` sized cells, rivals of a row lie in its own and the eight
    cells around.  In each round the first open row of a cell is kept when no cell around
    has an earlier one; then everything within reach of the new rows is dropped.  A cell
    sends one row per map task, and at least the first open row of every group settles
    per round.  Centers lie in the unit square, so a group has few cells.
    """
    columns = rows.columns
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("int")
    open_rows = rows.withColumns({"_gx": cell("cx"), "_gy": cell("cy")})
    around = F.explode(F.expr(
        "flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"
    ))
    row = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*order)
    kept = None
    open_rows = freeze(open_rows)
    while not open_rows.isEmpty():
        firsts = freeze(
            open_rows.groupBy(*keys, "_gx", "_gy").agg(F.min(rank).alias("_rank"), F.min_by(row, rank).alias("_row"))
        )
        spread = firsts.select(*keys, "_gx", "_gy", "_rank", around.alias("_d")).select(
            *keys, (F.col("_gx") + F.col("_d.i")).alias("_gx"), (F.col("_gy") + F.col("_d.j")).alias("_gy"), "_rank"
        )
        best = spread.groupBy(*keys, "_gx", "_gy").agg(F.min("_rank").alias("_best"))
        won = freeze(
            firsts.join(best, [*keys, "_gx", "_gy"]).filter(F.col("_rank") == F.col("_best")).select("_gx", "_gy", "_row")
        )
        found = won.select("_row.*")
        kept = found if kept is None else kept.unionByName(found)
        reach = won.select(
            "_gx", "_gy", F.col("_row.cx").alias("_wx"), F.col("_row.cy").alias("_wy"),
            *[F.col(f"_row.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], around.alias("_d"),
        ).select(
            (F.col("_gx") + F.col("_d.i")).alias("_rx"), (F.col("_gy") + F.col("_d.j")).alias("_ry"), "_wx", "_wy",
            *[f"_k{i}" for i in range(len(keys))],
        )
        match = [F.col("_gx") == F.col("_rx"), F.col("_gy") == F.col("_ry")]
        match += [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        match += [F.abs(F.col("cx") - F.col("_wx")) <= tolerance, F.abs(F.col("cy") - F.col("_wy")) <= tolerance]
        open_rows = freeze(open_rows.join(reach, reduce(lambda a, b: a & b, match), "left_anti"))
    return kept if kept is not None else rows.limit(0)


def collapse_detections(detections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys + (content, format)``: the first with a position, else the first;
    it takes the slot of the first.  One aggregate, no window."""
    group = [*keys, "content", "format"]
    rest = [c for c in detections.columns if c not in group]
    rank = F.struct(F.when(has_position(), 0).otherwise(1).alias("p"), *order)
    out = detections.groupBy(*group).agg(
        F.min(order[0]).alias("slot"), F.min_by(F.struct(*rest), rank).alias("_r")
    )
    return out.select(*group, "slot", *[F.col(f"_r.{c}").alias(c) for c in rest])


def reading_order(detections: DataFrame, keys: list[str], ties: list[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """``line`` and ``position``: lines are runs whose vertical steps stay within the
    tolerance; inside a line left to right, then top down."""
    spread = any_group_over(detections, keys)
    lined = islands(
        detections, keys, ["cy", "cx", *ties], "cy", F.col("cy") - F.col("_previous") > tolerance, "line", spread
    )
    return row_numbers(lined, keys, ["line", "cx", "cy", *ties], "position", spread)


def mean_confidence(recognitions: DataFrame, key: str = "image_id") -> DataFrame:
    """Mean over all blocks of an image: finite character scores, else the finite box score."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    chosen = F.filter(
        F.when(F.size("scores") > 0, F.col("scores")).otherwise(F.array("box_score")), finite
    )
    parts = recognitions.select(
        key, F.size(chosen).alias("n"), F.aggregate(chosen, F.lit(0.0), lambda acc, x: acc + x).alias("s")
    )
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    bounded = F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))
    return parts.groupBy(key).agg(F.coalesce(bounded, F.lit(0.0)).alias("confidence"))


def best_recognition(attempts: DataFrame, key: str = "image_id") -> DataFrame:
    """The attempt with the highest score, then confidence, then the earliest profile.
    Attempts of one image come from one row, so the partial aggregate leaves one per task."""
    rank = F.struct(F.col("score"), F.col("confidence"), -F.col("profile_ord"))
    best = attempts.groupBy(key).agg(F.max_by(F.struct("profile", "score", "confidence"), rank).alias("b"))
    return best.select(key, "b.profile", "b.score", "b.confidence")
