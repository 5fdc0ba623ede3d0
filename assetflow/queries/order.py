"""Order-dependent operators on outcomes, frames and detections (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import derive, duck
from assetflow.operators import detections as DT
from assetflow.operators import frames
from assetflow.plans import outcomes
from assetflow.queries.base import query, rounded

WORK_ORDER = ["finished_at", "item_no", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "work_items", "l_returnflag", "l_linestatus"]


@query(duck("work", f"""
SELECT run_id, item_no, l_partkey, CAST(pw AS BIGINT) AS processed_work, pf AS processed_files, CAST(ff AS BIGINT) AS failed_files, round(least(greatest(100.0::DOUBLE * pw / tw, 0), 100), 6) AS percent FROM (
  SELECT *, sum(work_items) OVER w AS pw, count(*) OVER w AS pf, sum(CAST(failed AS INT)) OVER w AS ff, sum(work_items) OVER (PARTITION BY run_id) AS tw FROM work
  WINDOW w AS (PARTITION BY run_id ORDER BY {', '.join(WORK_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def progress_timeline(spark, sf):
    return outcomes.progress_timeline(derive(spark, sf, "work"), WORK_ORDER).select(
        "run_id", "item_no", "l_partkey", "processed_work", "processed_files", "failed_files", rounded("percent").alias("percent")
    )


@query(duck("frames", """
SELECT asset_id, frame_no, 10 * coalesce(CASE WHEN delay_cs > 0 THEN delay_cs END, last_value(CASE WHEN delay_cs > 0 THEN delay_cs END IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 10) AS delay_ms FROM frames"""))
def frame_delays(spark, sf):
    return frames.frame_delays(derive(spark, sf, "frames"), ["asset_id"], ["frame_no"]).select("asset_id", "frame_no", "delay_ms")


DT_ORDER = ["seq", "tie", "tie2", "tie3", "cx", "cy"]
MERGE_SQL = "WITH RECURSIVE " + duck("detections", "").removeprefix("WITH ") + """
, s AS (SELECT *, dense_rank() OVER (ORDER BY image_id, content, format ) AS gid, row_number() OVER (PARTITION BY image_id, content, format ORDER BY seq, tie, tie2, tie3, cx, cy) AS i, cx > 0.001 OR cy > 0.001 AS pos FROM detections)
, walk AS (SELECT DISTINCT gid, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, p BOOLEAN)[]) AS kept, CAST(FALSE AS BOOLEAN) AS fresh FROM s
  UNION ALL
  SELECT gid, i, CASE WHEN dup THEN kept ELSE list_append(kept, {'x': cx, 'y': cy, 'p': pos}) END, NOT dup FROM (
    SELECT w.gid, s.i, w.kept, s.cx, s.cy, s.pos, len(list_filter(w.kept, lambda k: NOT k.p OR NOT s.pos OR (abs(k.x - s.cx) <= 0.12 AND abs(k.y - s.cy) <= 0.12))) > 0 AS dup
    FROM walk w JOIN s ON s.gid = w.gid AND s.i = w.i + 1))
SELECT s.image_id, s.content, s.format, s.seq, s.tie, round(s.cx, 6) AS cx, round(s.cy, 6) AS cy FROM s JOIN walk w ON w.gid = s.gid AND w.i = s.i WHERE w.fresh"""


@query(MERGE_SQL)
def merge_detections(spark, sf):
    merged = DT.merge_detections(
        derive(spark, sf, "detections"), ["image_id", "content", "format"], DT_ORDER, DT.BARCODE_TOLERANCE
    )
    return merged.select("image_id", "content", "format", "seq", "tie", rounded("cx").alias("cx"), rounded("cy").alias("cy"))


QR_SQL = (
    MERGE_SQL.replace("image_id, content, format ", "image_id, content ").replace("NOT k.p OR NOT s.pos OR ", "").replace("0.12", "0.05")
)


@query(QR_SQL)
def merge_qr_detections(spark, sf):
    """Content alone decides here, and a missing position is a position like any other."""
    merged = DT.merge_detections(
        derive(spark, sf, "detections"), ["image_id", "content"], DT_ORDER, DT.QR_TOLERANCE, positionless_match=False
    )
    return merged.select("image_id", "content", "format", "seq", "tie", rounded("cx").alias("cx"), rounded("cy").alias("cy"))


@query(duck("detections", """
SELECT image_id, content, format, slot, seq, tie, round(cx, 6) AS cx, round(cy, 6) AS cy FROM (SELECT *, min(seq) OVER (PARTITION BY image_id, content, format) AS slot FROM detections)
QUALIFY row_number() OVER (PARTITION BY image_id, content, format ORDER BY CASE WHEN cx > 0.001 OR cy > 0.001 THEN 0 ELSE 1 END, seq, tie, tie2, tie3, cx, cy) = 1"""))
def collapse_detections(spark, sf):
    out = DT.collapse_detections(derive(spark, sf, "detections"), ["image_id"], DT_ORDER)
    return out.select(
        "image_id", "content", "format", "slot", "seq", "tie", rounded("cx").alias("cx"), rounded("cy").alias("cy")
    )


@query(duck("detections", """
, l AS (SELECT *, sum(CASE WHEN prev IS NULL OR cy - prev > 0.08 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY cy, cx, seq, tie, tie2, tie3 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line
  FROM (SELECT *, lag(cy) OVER (PARTITION BY image_id ORDER BY cy, cx, seq, tie, tie2, tie3) AS prev FROM detections))
SELECT image_id, seq, tie, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY image_id ORDER BY line, cx, cy, seq, tie, tie2, tie3) AS position FROM l"""))
def reading_order(spark, sf):
    return DT.reading_order(derive(spark, sf, "detections"), ["image_id"], ["seq", "tie", "tie2", "tie3"]).select(
        "image_id", "seq", "tie", "line", "position"
    )
