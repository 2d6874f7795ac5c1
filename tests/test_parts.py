"""Writing a table in parts that can be written again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from roadlens.plans.volume import write_imputed
from roadlens.sources.tables import read_table, write_part


def test_a_failed_run_is_done_again(spark, tmp_path, monkeypatch):
    """The second part fails halfway; the whole job runs again and every row is there once."""
    from roadlens.plans import volume
    path = f"file://{tmp_path}/table"
    done = spark.range(40).select("id", (F.col("id") * 1.5).alias("v"), (F.col("id") % 4 == 0).alias("is_predicted"))
    real = volume.write_part

    def fails(df, name, part, fmt):
        real(df.limit(3) if part == "predicted" else df, name, part, fmt)
        if part == "predicted":
            raise OSError("lost")

    monkeypatch.setattr(volume, "write_part", fails)
    with pytest.raises(OSError, match="lost"):
        write_imputed(done, path)
    assert read_table(spark, path).count() == 33
    monkeypatch.undo()
    for _ in range(2):
        write_imputed(done, path)
        want = done.select("id", "v", F.when(F.col("is_predicted"), "predicted").otherwise("recorded").alias("part"))
        assert rows(read_table(spark, path), "id", "v", "part") == rows(want)


def test_parts_keep_to_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    write_part(spark.range(3).select("id", F.lit("x").alias("s")), path, "a")
    write_part(spark.range(5).select(F.lit("y").alias("s"), "id"), path, "b")
    write_part(spark.range(1).select("id", F.lit("z").alias("s")), path, "a")
    assert rows(read_table(spark, path), "id", "s", "part") == [(0, "y", "b"), (0, "z", "a"), *((i, "y", "b") for i in range(1, 5))]
    with pytest.raises(ValueError, match="column part"):
        write_part(spark.range(1).select(F.lit(1).alias("part")), path, "a")
