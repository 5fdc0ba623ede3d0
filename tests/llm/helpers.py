from __future__ import annotations

SF = "/root/testdata/sf0.001"


def table_rows(spark, name: str) -> list:
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()
