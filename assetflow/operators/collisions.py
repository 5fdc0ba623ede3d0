"""Unique output names, in input order.

A planned name ``base`` that is taken becomes ``base(1)``, ``base(2)``, ... with case
ignored; files that exist and names given out earlier count as taken.  The rule is
sequential, but a name ``b(k)`` can only be wanted by two parties: the items whose
base is ``b`` (their k-th choice) and the first item whose own base is ``b(k)``.
So items are grouped in families of equal base and the families settled from the
shortest bases to the longest, each step a few keyed joins and running counts.  A
family's items are never gathered in one task; only the *contested* choices between
two families are walked in order.  When those are many, blocks of them are walked side by side: what
a block does to the number of earlier losses is a step function, and step functions compose.
Families without rivals and taken names are only numbered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.operators.ordered import group_limit, ordered_scan, row_numbers
from assetflow.session import freeze, ship_package

NUMBERED = r"^(.*)\(([1-9][0-9]{0,17})\)$"
FAMILY = ["job_id", "_folder", "_base", "_ext"]


def _parent(base: Column) -> Column:
    return F.regexp_extract(base, NUMBERED, 1)


def _slot(base: Column) -> Column:
    return F.regexp_extract(base, NUMBERED, 2).try_cast("bigint")


def _depth(base: Column) -> Column:
    """How many ``(n)`` groups end the name."""
    tail = F.regexp_extract(base, r"((?:\([1-9][0-9]{0,17}\))*)$", 1)
    return (F.length(tail) - F.length(F.translate(tail, "(", ""))).cast("int")


def numbered_base(base: Column, slot: Column) -> Column:
    return F.concat(base, F.lit("("), slot.cast("string"), F.lit(")"))


def destination(folder: Column, base: Column, slot: Column, ext: Column) -> Column:
    name = F.when(slot > 0, numbered_base(base, slot)).otherwise(base)
    return F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), F.lit("/"), name, ext)


def resolve_collisions(plan: DataFrame, reserved: DataFrame | None = None, item: str = "asset_id") -> DataFrame:
    """Adds ``slot`` (0 keeps the base) and ``destination``.

    ``plan`` has ``job_id, folder, base_name, ext_out, seq, allow_overwrite`` and an
    ``item`` that is unique within its job; ``ext_out`` is empty for folders, which never overwrite.
    ``reserved`` has ``folder, file_name`` of paths that exist already.
    """
    lowered = {
        "_folder": F.lower(F.regexp_replace("folder", r"[/\\]+$", "")),
        "_base": F.lower("base_name"),
        "_ext": F.lower("ext_out"),
    }
    overwrites = F.col("allow_overwrite") & (F.col("_ext") != "")
    # Frozen: what decides the names, and no other column of the plan; it is read once per level.
    items = plan.select("job_id", item, "seq", "allow_overwrite", *[e.alias(n) for n, e in lowered.items()]).filter(~overwrites)
    items = freeze(items.select(*FAMILY, "seq", item, _depth(F.col("_base")).alias("_depth")))

    taken_before = None
    if reserved is not None:
        taken_before = reserved.select(
            F.lower(F.regexp_replace("folder", r"[/\\]+$", "")).alias("_folder"), F.lower("file_name").alias("_name")
        ).distinct()
    slots = _slots(items, taken_before, item)
    return (
        plan.join(slots, ["job_id", item], "left")
        .withColumn("slot", F.coalesce("slot", F.lit(0).cast("bigint")))
        .withColumn("destination", destination(F.col("folder"), F.col("base_name"), F.col("slot"), F.col("ext_out")))
        .select(*plan.columns, "slot", "destination")
    )


def _slots(items: DataFrame, taken_before: DataFrame | None, item: str) -> DataFrame:
    """``job_id, item, slot`` of all items that do not overwrite."""
    families = items.groupBy(*FAMILY, "_depth").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shape = families.agg(F.max("_n").alias("n"), F.collect_set("_depth").alias("depths")).first()
    depths = set(shape.depths)  # at most 127: a name has 255 characters
    limit = group_limit(items)
    spread = (shape.n or 0) > limit
    numbered = lambda rows: row_numbers(rows, FAMILY, ["seq"], "_j", spread).select("job_id", item, (F.col("_j") - 1).alias("slot"))
    if taken_before is None and not depths - {0}:
        return numbered(items)
    known = freeze(_known(families, taken_before))
    rivals = known.filter("_first is not null").select(
        "job_id", "_folder", numbered_base(F.col("_base"), F.col("_k")).alias("_base"), "_ext", F.col("_depth") + 1
    )
    keys = known.select(*FAMILY, "_depth").union(rivals).groupBy(*FAMILY, "_depth").agg(F.count(F.lit(1)).alias("_c"))
    most = keys.agg(F.max("_c").alias("c"), F.collect_set("_depth").alias("depths")).first()
    levels, fold = set(most.depths), (most.c or 0) < min(limit, FOLD_LIMIT)
    spread = shape.n is not None and shape.n + (most.c or 0) > limit
    keys = keys.select(*FAMILY)
    solved, given = numbered(items.join(keys, FAMILY, "left_anti")), None
    for depth in sorted(levels):
        level = items.filter(F.col("_depth") == depth).join(keys, FAMILY, "left_semi")
        slots = _settle_level(level, known.filter(F.col("_depth") == depth), given, item, depth + 1 in levels, spread, fold)
        if depth + 1 in levels:
            slots = freeze(slots)  # read again by the next level; cuts the growing plan
        given = slots.filter(F.col("slot") > 0).select("job_id", "_folder", "_ext", numbered_base(F.col("_base"), F.col("slot")).alias("_base"))
        solved = solved.unionByName(slots.select("job_id", item, "slot"))
    return solved


def _known(families: DataFrame, taken_before: DataFrame | None) -> DataFrame:
    """``family, _depth, _k, _first``: choice k of a family is the name of an existing file (``_first`` is null), or also the base of
    another family, whose first item comes at ``_first``."""
    rows = families.select(*FAMILY, "_depth")
    own = families.filter(F.col("_depth") > 0).select(
        "job_id", "_folder", _parent(F.col("_base")).alias("_p"), "_ext", _slot(F.col("_base")).alias("_k"), "_first"
    )
    claims = rows.join(own.withColumnRenamed("_p", "_base"), FAMILY).select(*FAMILY, "_depth", "_k", "_first")
    return claims if taken_before is None else claims.union(_fixed_blocks(rows, taken_before).withColumn("_first", F.lit(None)))


def _settle_level(level, known, given, item, contested, spread, fold) -> DataFrame:
    """Slot of every item of the families in ``level``."""
    blocks = known.filter("_first is null").select(*FAMILY, "_k")
    if given is not None:
        # the parent family gave this base away before its first own item came
        gone = level.select(*FAMILY).distinct().join(given, FAMILY, "left_semi")
        blocks = blocks.union(gone.select(*FAMILY, F.lit(0).cast("bigint"))).distinct()
    ranked = row_numbers(level, FAMILY, ["seq"], "_j", spread).withColumn("_j", F.col("_j") - 1)
    if not contested:
        return _shift(ranked, blocks, item, spread)
    lost_anyway = blocks.withColumn("_limit", F.lit(2**62).cast("bigint"))
    choices = _limits(level, known.filter("_first is not null"), spread)
    choices = choices.join(blocks, [*FAMILY, "_k"], "left_anti").unionByName(lost_anyway)
    skipped = _skipped(choices) if fold else _skipped_at_scale(choices)
    return _shift(ranked, skipped, item, spread)


def _fixed_blocks(families: DataFrame, taken_before: DataFrame) -> DataFrame:
    """``family, _depth, _k``: choices that exist before any item comes."""
    names = taken_before.withColumn("_hit", F.lit(True))
    # a reserved name blocks choice 0 of the base it spells and choice k of its parent
    whole = families.withColumn("_name", F.concat("_base", "_ext"))
    spelt = whole.join(names, ["_folder", "_name"], "left_semi").select(*FAMILY, "_depth", F.lit(0).cast("bigint").alias("_k"))
    # an output extension is the last one of a name; a folder has none
    ext = F.explode(F.array_distinct(F.array(F.lit(""), F.regexp_extract("_name", r"(\.[^.]*)$", 1))))
    split = (
        taken_before.select("_folder", "_name", ext.alias("_ext"))
        .withColumn("_stem", F.expr("substr(_name, 1, length(_name) - length(_ext))"))
        .select("_folder", "_ext", _parent(F.col("_stem")).alias("_base"), _slot(F.col("_stem")).alias("_k"))
        .filter(F.col("_k").isNotNull())
    )
    return spelt.union(families.join(split, ["_folder", "_ext", "_base"]).select(*FAMILY, "_depth", "_k")).distinct()


def _limits(level, claims, spread) -> DataFrame:
    """``family, _k, _limit``: how many skipped choices still let the rival win choice k.

    The rival's first item gets it when it comes before the family's own item that reaches
    k.  With s choices skipped so far that own item is number k + 1 - s, so the choice is
    lost exactly when s < k + 1 - (own items before the rival).
    """
    own = level.select(*FAMILY, F.col("seq").alias("_at"), F.lit(None).cast("bigint").alias("_k"), F.lit(1).alias("_own"))
    other = claims.select(*FAMILY, F.col("_first").alias("_at"), "_k", F.lit(0).alias("_own"))
    merged = ordered_scan(
        own.unionByName(other), FAMILY, ["_at", "_own", "_k"], sums={"_before": F.col("_own").cast("bigint")}, spread=spread
    )
    return merged.filter(F.col("_own") == 0).select(*FAMILY, "_k", (F.col("_k") + 1 - F.col("_before")).alias("_limit"))


FOLD_LIMIT = 2_000  # contested choices that may stand in one list


def _skipped(choices: DataFrame) -> DataFrame:
    """``family, _k`` of the choices the family's items pass over, walked in rising order."""
    none = F.array().cast("array<bigint>")

    def step(lost: Column, choice: Column) -> Column:
        gone = F.size(lost) < choice["_limit"]
        return F.when(gone, F.concat(lost, F.array(choice["_k"]))).otherwise(lost)

    listed = choices.groupBy(*FAMILY).agg(F.array_sort(F.collect_list(F.struct("_k", "_limit"))).alias("_all"))
    return listed.select(*FAMILY, F.explode(F.aggregate("_all", none, step)).alias("_k"))


FAN, NODE_LIMIT = 16, 500_000  # blocks that become one in a round; choices of a family that one row may stand for


def _composed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The step function of two runs of choices, one after the other.

    A run turns ``s`` earlier losses into ``s`` plus the number of its steps above ``s``; steps are sorted and differ.  A choice
    alone has its limit as its only step.  A step v of the second run stands at the least ``s`` that the first run turns into v or more.
    """
    reached = first + np.arange(len(first) - 1, -1, -1)  # what the first run turns each of its steps into
    at = second - len(first) + np.searchsorted(reached, second, "left")
    return np.sort(np.concatenate([first, at[at > 0]]))


def _run_steps(limits: np.ndarray) -> np.ndarray:
    """The step function of choices in order, by halves; a limit below 1 is never lost."""
    parts = [np.array([x], np.int64) for x in limits if x > 0] or [np.zeros(0, np.int64)]
    while len(parts) > 1:
        parts = [_composed(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _after(state: int, steps: np.ndarray) -> int:
    return state + len(steps) - int(np.searchsorted(steps, state, "right"))


def _skipped_at_scale(choices: DataFrame) -> DataFrame:
    """The same without a family in one task.

    Blocks of consecutive choices become step functions, blocks of blocks likewise, ``FAN`` at a time, so the rounds grow with the
    logarithm of the blocks, until a row would stand for more than ``NODE_LIMIT`` choices.  The few rows left of a
    family are walked from a guessed number of earlier losses until every guess equals what the rows before really
    lose, and the way down hands each block its own number.
    """
    ship_package(choices.sparkSession)
    at = F.floor((F.col("_i") - 1) / FOLD_LIMIT).cast("bigint")
    numbered = row_numbers(choices, FAMILY, ["_k"], "_i", spread=True).withColumn("_node", at)
    blocks = freeze(
        numbered.groupBy(*FAMILY, "_node").agg(F.array_sort(F.collect_list(F.struct("_k", "_limit"))).alias("_all"))
    )
    key = ", ".join(f"{c} {choices.schema[c].dataType.simpleString()}" for c in FAMILY)
    node = f"{key}, _node bigint"

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_steps=[_run_steps(np.asarray(x, np.int64)) for x in b["_steps"]])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_node")
        whole = reduce(_composed, [np.asarray(x, np.int64) for x in group["_steps"]])
        return group.iloc[:1].assign(_node=group["_node"].iloc[0] // FAN, _steps=[whole])

    def hand(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_node")
        states = [int(group["_in"].iloc[0])]
        for x in group["_steps"].iloc[:-1]:
            states.append(_after(states[-1], np.asarray(x, np.int64)))
        return group.assign(_in=states)[[*FAMILY, "_node", "_in"]]

    up = (F.col("_node") / FAN).cast("bigint")
    limits = blocks.select(*FAMILY, "_node", F.transform("_all", lambda c: c["_limit"]).alias("_steps"))
    tree = [freeze(limits.mapInPandas(steps, f"{node}, _steps array<bigint>"))]
    width, most = FOLD_LIMIT * FAN, tree[0].agg(F.max("_node")).first()[0] or 0
    while most > 0 and width <= NODE_LIMIT:
        tree.append(freeze(tree[-1].groupBy(*FAMILY, up.alias("_up")).applyInPandas(join, f"{node}, _steps array<bigint>")))
        width, most = width * FAN, most // FAN

    state = _guessed(tree[-1])
    for level in tree[-2::-1]:
        above = state.withColumnRenamed("_node", "_up")
        below = level.withColumn("_up", up).join(above, [*FAMILY, "_up"])
        state = below.groupBy(*FAMILY, "_up").applyInPandas(hand, f"{node}, _in bigint")
    none = F.array().cast("array<bigint>")

    def keep(lost: Column, choice: Column) -> Column:
        gone = F.col("_in") + F.size(lost) < choice["_limit"]
        return F.when(gone, F.concat(lost, F.array(choice["_k"]))).otherwise(lost)

    final = blocks.join(state, [*FAMILY, "_node"])
    return final.select(*FAMILY, F.explode(F.aggregate("_all", none, keep)).alias("_k"))


def _guessed(nodes: DataFrame) -> DataFrame:
    """``family, _node, _in``: losses before every node.  Node n is right after n rounds at the latest, and the
    agreed state is the walk's own, because it is the only one that fits from the first node on."""
    state = nodes.select(*FAMILY, "_node", F.lit(0).cast("bigint").alias("_in"))
    while True:
        lost = F.size(F.filter("_steps", lambda t: t > F.col("_in"))).cast("bigint")
        walked = nodes.join(state, [*FAMILY, "_node"]).select(*FAMILY, "_node", "_in", lost.alias("_lost"))
        counted = ordered_scan(walked, FAMILY, ["_node"], sums={"_s": F.col("_lost")})
        step = freeze(counted.select(*FAMILY, "_node", "_in", (F.col("_s") - F.col("_lost")).alias("_next")))
        settled = step.filter(F.col("_next") != F.col("_in")).isEmpty()
        state = step.select(*FAMILY, "_node", F.col("_next").alias("_in"))
        if settled:
            return state


def _shift(ranked: DataFrame, skipped: DataFrame, item: str, spread: bool) -> DataFrame:
    """Item j takes the j-th choice that is not skipped.  Skip number i at choice s moves
    every item from position s - i on by one; a merged running count adds them up."""
    numbered = row_numbers(skipped, FAMILY, ["_k"], "_i", spread)
    moves = numbered.select(
        *FAMILY, (F.col("_k") - (F.col("_i") - 1)).alias("_at"), F.lit(1).alias("_move"),
        F.col("_k").alias("_tie"), F.lit(None).cast(ranked.schema[item].dataType).alias(item),
    )
    rows = ranked.select(
        *FAMILY, F.col("_j").alias("_at"), F.lit(0).alias("_move"), F.lit(None).cast("bigint").alias("_tie"), item
    )
    merged = ordered_scan(
        rows.unionByName(moves), FAMILY, ["_at", F.col("_move").desc(), "_tie"],
        sums={"_shift": F.col("_move").cast("bigint")}, spread=spread,
    )
    return merged.filter(F.col("_move") == 0).select(*FAMILY, item, (F.col("_at") + F.col("_shift")).alias("slot"))
