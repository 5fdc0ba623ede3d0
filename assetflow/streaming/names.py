"""Output names of a watch stream from keyed state.

Names that can meet share a folder, an extension and a root: the base without the ``(n)`` groups at its end.  That is the key, so each
name is looked up in the state of its own key, and what a batch costs depends on its own files, not on all names ever given.  A base
also remembers the number it reached; no number is tried twice.  State is versioned with the checkpoint: a batch that is
repeated gives the same names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assetflow.functions.options import normalize_options, watch_rules
from assetflow.operators.collisions import destination
from assetflow.operators.lookups import lock_skips
from assetflow.plans.conversion import named_outputs, route
from assetflow.plans.expand import expand_outputs

KEYS = ["folder_key", "root", "ext_key"]
NO_NAME, OVERWRITES, OWN_NAME = 0, 1, 2
_GIVEN = T.StructType([T.StructField("payload", T.StringType()), T.StructField("slot", T.LongType())])
_NAME, _BASE = (T.StructType([T.StructField(n, T.StringType())]) for n in ("name", "base"))
_NUMBER = T.StructType([T.StructField("slot", T.LongType())])


class NameKeeper(StatefulProcessor):
    """Gives out the names of one key, in order.  The rows of a key in one micro-batch are sorted together; the source's trigger
    limit bounds them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", _NAME, _NUMBER)
        self.reached = handle.getMapState("reached", _BASE, _NUMBER)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name in initialState["name"]:
            self.taken.updateValue((name,), (0,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "tie"], kind="stable")
        reached: dict[str, int] = {}
        slots: list[int | None] = []
        for base, mode in zip(batch["base"], batch["mode"], strict=True):
            if mode == NO_NAME:
                slots.append(None)
                continue
            if mode == OVERWRITES:
                slot = 0
            else:
                if base not in reached:
                    reached[base] = self.reached.getValue((base,))[0] if self.reached.containsKey((base,)) else 0
                slot = reached[base]
                while self.taken.containsKey((f"{base}({slot})" if slot else base,)):
                    slot += 1
                reached[base] = slot + 1
            self.taken.updateValue((f"{base}({slot})" if slot else base,), (slot,))
            slots.append(slot)
        for base, slot in reached.items():
            self.reached.updateValue((base,), (slot,))
        yield pd.DataFrame({"payload": batch["payload"].tolist(), "slot": pd.Series(slots, dtype="Int64")})

    def close(self) -> None:
        pass


# The driver-side check of a stateful stream imports nothing shipped with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _folder_key(folder: Column) -> Column:
    return F.lower(F.regexp_replace(folder, r"[/\\]+$", ""))


def _root(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"(\([1-9][0-9]{0,17}\))+$", "")


def held_names(existing: DataFrame) -> DataFrame:
    """``existing`` (folder, file_name) by the keys under which a new name could meet them: as a file and as a folder."""
    file = F.lower("file_name")
    stem, ext = F.regexp_extract(file, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(file, r"^(.*?)(\.[^.]*)?$", 2)
    as_file = F.struct(_root(stem).alias("root"), ext.alias("ext_key"), stem.alias("name"))
    as_folder = F.struct(_root(file).alias("root"), F.lit("").alias("ext_key"), file.alias("name"))
    rows = existing.select(_folder_key(F.col("folder")).alias("folder_key"), F.explode(F.array(as_file, as_folder)).alias("n"))
    return rows.select("folder_key", "n.*").distinct()


def named_stream(ready: DataFrame, profiles: DataFrame, existing: DataFrame | None = None, seq: str = "asset_id") -> DataFrame:
    """Ready files (with ``job_id`` naming their profile) planned one by one, with ``slot`` and ``destination``; both null where
    the file is locked.  Within a micro-batch names are given in order of ``seq``.  ``existing`` (folder, file_name) are files that are
    there when the stream begins.  Needs the RocksDB state store."""
    planned = watch_rules(ready.join(normalize_options(profiles), "job_id"))
    named = named_outputs(lock_skips(route(planned)).withColumn("batch_index", F.lit(0).cast("bigint")))
    overwrites = F.col("allow_overwrite") & (F.col("ext_out") != "")
    rows = named.select(
        _folder_key(F.col("folder")).alias("folder_key"), _root(F.col("base_name")).alias("root"), F.lower("ext_out").alias("ext_key"),
        F.lower("base_name").alias("base"), F.col(seq).cast("bigint").alias("seq"), F.xxhash64("job_id", "path").alias("tie"),
        F.when(F.col("locked"), NO_NAME).when(overwrites, OVERWRITES).otherwise(OWN_NAME).alias("mode"),
        F.to_json(F.struct(*named.columns)).alias("payload"),
    )
    held = held_names(existing).groupBy(*KEYS) if existing is not None else None
    given = rows.groupBy(*KEYS).transformWithStateInPandas(NameKeeper(), _GIVEN, outputMode="Append", timeMode="None", initialState=held)
    back = given.select(F.from_json("payload", named.schema).alias("p"), "slot").select("p.*", "slot")
    place = destination(F.col("folder"), F.col("base_name"), F.col("slot"), F.col("ext_out"))
    return back.withColumn("destination", F.when(F.col("slot").isNotNull(), place))


def named_writer(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for :func:`named_stream`: outputs, failures and a summary of each micro-batch below ``root``, under
    the batch number.  A batch that is repeated replaces its folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            outputs = expand_outputs(rows.filter(~F.col("locked"))).select("job_id", "asset_id", "output_no", "strategy", "destination", "output_name")
            failures = rows.filter("locked").select("job_id", "asset_id", "file_name", F.col("skip_reason").alias("reason"))
            summary = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_count"), F.count_if("locked").alias("failure_count"))
            for name, part in (("outputs", outputs), ("failures", failures), ("history", summary)):
                part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            rows.unpersist()

    return handle
