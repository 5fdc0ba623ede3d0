"""Windows and blocks must give the same rows; hot keys take the second way."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assetflow.operators import ordered
from assetflow.operators.detections import _merge_rounds, merge_detections, reading_order
from assetflow.operators.frames import frame_delays
from assetflow.operators.numbering import batch_index


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, t long, v int").repartition(5)


def test_blocks_equal_windows(spark, skewed):
    kwargs = {"sums": {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}, "carries": {"c": F.col("v")}}
    plain = ordered.ordered_scan(skewed, ["k"], ["t"], **kwargs, spread=False)
    split = ordered.ordered_scan(skewed, ["k"], ["t"], **kwargs, spread=True)
    key = lambda rows: sorted(rows, key=lambda r: r[1])
    assert key([tuple(r) for r in plain.collect()]) == key([tuple(r) for r in split.collect()])


def test_descending_blocks(spark, skewed):
    order = [F.col("t").desc()]
    split = ordered.ordered_scan(skewed, ["k"], order, carries={"c": F.struct("t")}, spread=True)
    plain = ordered.ordered_scan(skewed, ["k"], order, carries={"c": F.struct("t")}, spread=False)
    pick = lambda df: rows_of(df.select("t", "c.t"))
    assert sorted(map(str, pick(split))) == sorted(map(str, pick(plain)))


def test_no_keys_and_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [(1, i) for i in range(40, 60)], "k int, t long")
    split = ordered.ordered_scan(df, ["k"], ["t"], sums={"n": F.lit(1)}, spread=True)
    assert [r.n for r in split.orderBy("t").collect()] == list(range(1, 41)) + list(range(1, 21))
    whole = ordered.ordered_scan(df, [], ["t"], sums={"n": F.lit(1)}, spread=True)
    assert [r.n for r in whole.orderBy("t").collect()] == list(range(1, 61))


def test_sizes_are_looked_at(spark, skewed, small_groups):
    assert ordered.any_group_over(skewed, ["k"])
    assert not ordered.any_group_over(skewed, ["t"])


def test_first_per_key_limits_before_the_shuffle(spark, skewed):
    plan = ordered.first_per_key(skewed, [F.col("k")], ["t"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert plan.index("Final") < plan.rindex("Partial")


def test_batch_index_of_hot_job(spark, small_groups):
    df = spark.range(50).select(F.lit(7).alias("job_id"), (49 - F.col("id")).alias("asset_id"))
    assert [r.batch_index for r in batch_index(df, ["asset_id"]).orderBy("asset_id").collect()] == list(range(50))


def greedy(rows, tolerance):
    kept = []
    for seq, x, y in sorted(rows):
        if not any(abs(x - a) <= tolerance and abs(y - b) <= tolerance for _, a, b in kept):
            kept.append((seq, x, y))
    return kept


@pytest.mark.parametrize("positionless", [False, True])
def test_merge_rounds_equal_the_greedy_walk(spark, positionless):
    rng = random.Random(11)
    data = [(1, s, rng.randrange(1, 21) / 20, rng.randrange(1, 21) / 20) for s in range(150)]
    data += [(2, s, rng.random(), rng.random()) for s in range(150)] + [(3, 0, 0.5, 0.5)]
    df = spark.createDataFrame(data, "k int, seq int, cx double, cy double")
    want = sorted((k, *r) for k in (1, 2, 3) for r in greedy([d[1:] for d in data if d[0] == k], 0.12))
    fold = merge_detections(df, ["k"], ["seq"], 0.12, positionless)
    assert rows_of(fold.select("k", "seq", "cx", "cy")) == want
    rounds = _merge_rounds(df, ["k"], ["seq"], 0.12)
    assert rows_of(rounds.select("k", "seq", "cx", "cy")) == want


@pytest.mark.parametrize("rows_per_task", ["2000000", "1"])
def test_detection_without_position_absorbs_the_rest(spark, rows_per_task):
    spark.conf.set("assetflow.group.rows", rows_per_task)
    df = spark.createDataFrame(
        [(1, 0, 0.0, 0.0), (1, 1, 0.5, 0.5), (2, 0, 0.5, 0.5), (2, 1, 0.0, 0.0), (2, 2, 0.9, 0.9)],
        "k int, seq int, cx double, cy double",
    )
    out = merge_detections(df, ["k"], ["seq"], 0.12)
    got = rows_of(out.select("k", "seq"))
    spark.conf.unset("assetflow.group.rows")
    assert got == [(1, 0), (2, 0), (2, 2)]


def test_reading_order(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.9, 0.10), (1, 1, 0.1, 0.12), (1, 2, 0.5, 0.50), (1, 3, 0.2, 0.55)], "image_id int, seq int, cx double, cy double"
    )
    out = reading_order(df, ["image_id"], ["seq"]).orderBy("position").collect()
    assert [r.seq for r in out] == [1, 0, 3, 2]


def test_frame_delays_inherit(spark, small_groups):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([0, 0, 5, 0, -1, 7, 0])], "asset_id int, frame_no int, delay_cs int")
    out = frame_delays(df, ["asset_id"], ["frame_no"]).orderBy("frame_no").collect()
    assert [r.delay_ms for r in out] == [100, 100, 50, 50, 50, 70, 70]
