"""Output names against the sequential rule, on small and on split families."""

from __future__ import annotations

import random

import numpy as np
import pytest

from assetflow.operators import collisions
from assetflow.operators.collisions import resolve_collisions

SCHEMA = "job_id long, folder string, base_name string, ext_out string, seq long, allow_overwrite boolean, asset_id long"


def sequential(rows, reserved):
    taken, out = {f"{f}/{n}".lower() for f, n in reserved}, {}
    given = {}
    for job, folder, base, ext, _seq, overwrite, item in sorted(rows, key=lambda r: (r[0], r[4])):
        mine = given.setdefault(job, set())
        if overwrite and ext:
            out[item] = f"{folder}/{base}{ext}"
            continue
        k = 0
        while True:
            name = f"{folder}/{base}{f'({k})' if k else ''}{ext}"
            if name.lower() not in taken and name.lower() not in mine:
                break
            k += 1
        mine.add(name.lower())
        out[item] = name
    return out


def check(spark, rows, reserved=()):
    plan = spark.createDataFrame(rows, SCHEMA)
    held = spark.createDataFrame(list(reserved), "folder string, file_name string") if reserved else None
    got = {r.asset_id: r.destination for r in resolve_collisions(plan, held).collect()}
    assert got == sequential(rows, reserved)


def make(names, ext=".png", job=1):
    return [(job, "/out", n, ext, i, False, job * 1000 + i) for i, n in enumerate(names)]


def test_suffixed_inputs(spark):
    check(spark, make(["a", "a(1)", "a"]))
    check(spark, make(["a(1)", "a", "A", "a(1)", "a(1)(1)", "a(1)"]))


def test_existing_files_count(spark):
    check(spark, make(["a", "b", "a"]), [("/out", "A.png"), ("/out", "a(2).png"), ("/else", "b.png"), ("/out", "a(1).gif")])


def test_overwrite_bypasses_files_but_not_folders(spark):
    rows = [(1, "/o", "a", ".png", i, True, i) for i in range(3)] + [(1, "/o", "d", "", 3 + i, True, 3 + i) for i in range(3)]
    check(spark, rows)


def random_case(rng, n):
    names = [
        rng.choice("ab") + "".join(f"({rng.randrange(1, 6)})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))) for _ in range(n)
    ]
    reserved = [
        ("/out", rng.choice("ab") + "".join(f"({rng.randrange(1, 5)})" for _ in range(rng.choice([0, 1, 1, 2]))) + ".png")
        for _ in range(rng.randrange(0, 5))
    ]
    return names, sorted(set(reserved))


@pytest.mark.parametrize("seed", range(3))
def test_random_names(spark, seed):
    rng = random.Random(seed)
    rows, reserved = [], []
    names, reserved = random_case(rng, 40)
    rows += make(names, job=1)
    rows += make(random_case(rng, 30)[0], job=2)
    rng.shuffle(rows)
    check(spark, rows, reserved)


def test_families_split_over_tasks(spark, small_groups):
    rng = random.Random(5)
    names, reserved = random_case(rng, 25)
    check(spark, make(names), reserved)


def lost(limits, state):
    for x in limits:
        state += state < x
    return state


@pytest.mark.parametrize("seed", range(20))
def test_steps_of_a_run_compose(seed):
    rng = random.Random(seed)
    runs = [[rng.choice([rng.randrange(-3, 15), rng.randrange(60), 2**62]) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
    one, two = (collisions._run_steps(np.array(r, np.int64)) for r in runs)
    both = collisions._composed(one, two)
    assert len(set(both.tolist())) == len(both)
    for s in range(80):
        assert collisions._after(s, one) == lost(runs[0], s)
        assert collisions._after(s, both) == lost(runs[0] + runs[1], s)


# blocks alone, one round of composing, and rounds up to one row a family
@pytest.mark.parametrize("fan, node_limit", [(2, 4), (2, 8), (2, 10**6), (3, 10**6)])
def test_blocks_equal_the_fold(spark, monkeypatch, fan, node_limit):
    rng = random.Random(9)
    data = [(1, "/o", f, ".png", k, rng.choice([rng.randrange(-2, 40), 2**62])) for f, n in (("a", 41), ("b", 3), ("c", 25)) for k in range(1, n)]
    choices = spark.createDataFrame(data, "job_id long, _folder string, _base string, _ext string, _k long, _limit long")
    rows = lambda df: sorted((r._base, r._k) for r in df.collect())
    want = rows(collisions._skipped(choices))
    monkeypatch.setattr(collisions, "FOLD_LIMIT", 4)
    monkeypatch.setattr(collisions, "FAN", fan)
    monkeypatch.setattr(collisions, "NODE_LIMIT", node_limit)
    assert rows(collisions._skipped_at_scale(choices)) == want


def test_other_columns_keep_their_order(spark):
    plan = spark.createDataFrame([(7, *r) for r in make(["a", "A", "b"])], "extra int, " + SCHEMA)
    out = resolve_collisions(plan)
    assert out.columns == [*plan.columns, "slot", "destination"] and {r.extra for r in out.collect()} == {7}
    assert resolve_collisions(plan.limit(0)).count() == 0
