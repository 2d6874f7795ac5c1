"""What the plans read, push down and reuse."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from roadlens.catalog.fixtures import FIXTURES, Tables, with_fixtures
from roadlens.operators import joins as J
from roadlens.plans import arcs, exploration, routes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))


def test_filter_and_columns_reach_the_scan(tables):
    df = exploration.category_distribution(
        tables["lineitem"].where("l_returnflag = 'R'"), "l_linestatus")
    assert "EqualTo(l_returnflag,R)" in plan(df)
    assert scans(df) == ["l_returnflag:string,l_linestatus:string"]


def test_arc_attributes_read_the_events_once(tables):
    assert len(scans(arcs.arc_attributes(tables["lineitem"], ["l_linestatus"], "l_partkey"))) == 1


def test_crash_labels_read_each_input_once(tables):
    df = arcs.crash_labels(tables["fx_events"], tables["fx_crashes"])
    assert len(scans(df)) == 2


def test_event_mix_is_one_shuffle(tables):
    text = plan(arcs.event_mix(tables["fx_events"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1


def test_scores_of_all_models_cost_one_join(tables):
    models = {f"m{i}": tables["fx_scores"] for i in range(4)}
    text = plan(J.fold_scores(tables["fx_segments"], models, "arc"))
    assert len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) ", text)) == 1


def test_route_expansion_does_not_grow_with_trips(spark, tables):
    """The number of jobs is the same for a few trips and for all of them."""
    def jobs(points):
        group = f"jobs-{points}"
        spark.sparkContext.setJobGroup(group, group)
        trips = tables["fx_routes"]
        some = trips.where(F.col("route") < points)
        routes.expand_routes(some, tables["fx_segments"]).count()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few, many = jobs(10), jobs(10**6)
    assert abs(few - many) <= 8 and many < 60


def test_no_python_row_functions_in_relational_plans(spark):
    for name in ("arc_profile", "event_mix", "join_segment_range"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_stand_ins_read_alike_in_both_engines(spark):
    import duckdb
    connection = duckdb.connect()
    for name in ("part", "lineitem", "orders", "supplier", "nation", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    tables = Tables(spark, FOLDER)
    for name in FIXTURES:
        counted = connection.execute(with_fixtures(f"SELECT count(*) FROM {name}")).fetchone()[0]
        assert tables[name].count() == counted, name


def shared_files(spark) -> set[str]:
    from pathlib import Path

    from roadlens.session import shared_dir
    folder = Path(re.sub("^file:/*", "/", shared_dir(spark)))
    return {str(p) for p in folder.iterdir()} if folder.exists() else set()


def test_materialized_rows_lie_in_the_shared_folder_until_forgotten(spark):
    from roadlens.session import fresh_path, forget, materialize
    before = shared_files(spark)
    df = spark.range(5).select(F.col("id").alias("n", metadata={"unit": "m"}))
    kept = materialize(df)
    assert rows(kept) == rows(df) and kept.schema["n"].metadata == {"unit": "m"}
    assert len(shared_files(spark) - before) == 1
    forget(kept)
    assert shared_files(spark) == before
    forget(spark.range(3))  # wrote nothing
    path = fresh_path(spark, "own")
    assert len(shared_files(spark) - before) == 1 and "own-" in path


@pytest.mark.parametrize("configured", [True, False])
def test_nothing_is_left_when_the_process_ends(tmp_path, configured):
    """In a process of its own: rows kept by two queries are gone after its end."""
    import subprocess
    import sys
    from pathlib import Path
    shared, store = tmp_path / "shared", tmp_path / "warehouse"
    shared.mkdir()
    store.mkdir()
    setting = f'.config("spark.checkpoint.dir", "file://{shared}")' if configured else ""
    code = f"""
from pyspark.sql import SparkSession
from roadlens.session import clean, materialize
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", "file://{store}"){setting}.getOrCreate())
kept = [materialize(spark.range(n)) for n in (3, 4)]
assert [k.count() for k in kept] == [3, 4]
spark.stop()
"""
    root = Path(entry.__file__).parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
    until = time.monotonic() + 30  # the driver's JVM ends a little later
    left = lambda: [p for p in (*shared.rglob("*"), *store.rglob("*")) if p.is_file()]
    while left() and time.monotonic() < until:
        time.sleep(0.2)
    assert not left()  # Spark leaves an empty folder where the setting names


def test_storage_without_a_configured_folder():
    from types import SimpleNamespace

    from roadlens.session import shared_dir
    settings = {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}
    session = SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(applicationId="app-1", master="yarn"))
    assert shared_dir(session) == "hdfs://store/warehouse/shared-app-1"
    for own_disk in ("file:/data/warehouse", "/data/warehouse", "spark-warehouse"):
        settings["spark.sql.warehouse.dir"] = own_disk
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)
    session.sparkContext.master = "local[8]"
    assert shared_dir(session) == "spark-warehouse/shared-app-1"
    settings.clear()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_count_regression_writes_nothing_and_reads_the_events_twice(tables, monkeypatch):
    from roadlens import session
    from roadlens.plans import crash_models
    collected, frame = [], type(tables["part"])
    real = frame.collect
    monkeypatch.setattr(session, "stored", lambda *a: pytest.fail("rows were written"))
    monkeypatch.setattr(frame, "collect", lambda df: collected.append(df) or real(df))
    out = crash_models.crash_count_regression(
        tables["fx_event_rows"], tables["fx_crashes"], ["sample_speed"], ["tunnel"], ["trip_id", "arc"])
    head, sums = collected  # a look at the first rows, and the aggregate
    assert "Limit 1000" in plan(head) and head.count() == 1
    for df in (sums, out):
        planned = plan(df).split("== Initial Plan ==")[0]
        events = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", planned) if "l_orderkey" in s]
        assert len(events) == 1


def test_drilldown_reads_the_detail_twice(tables):
    """Once for the ranking, once for all sections."""
    df = exploration.arc_drilldown(tables["fx_text_events"])
    df.collect()
    assert len(re.findall("FileScan", plan(df).split("== Initial Plan ==")[0])) <= 2
    assert exploration.arc_drilldown(tables["fx_text_events"].limit(0)).count() == 0
