"""Kept tables: found again by another session, made anew for changed input, removed."""

import os
import shutil

import pytest

from staylens import session
from staylens.plans import kept
from staylens.plans.context import build_context
from staylens.sources.listings import listings_from_tpch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """A shared folder for kept tables, and a copy of the input."""
    monkeypatch.setattr(kept, "scratch_path", lambda spark, name: f"{tmp_path}/shared/{name}")
    data = tmp_path / "in"
    data.mkdir()
    for t in "region nation customer orders lineitem".split():
        shutil.copy(f"{SF}/{t}.parquet", data / f"{t}.parquet")
    return str(data)


def build(spark, data, **kw):
    return build_context(spark, listings_from_tpch(spark, data), materialize="table", **kw)


def test_second_session_reads_the_first_ones_table(spark, folder, monkeypatch):
    first = build(spark, folder)
    rows = sorted(map(tuple, first.baseline.collect()))
    assert kept.kept_names(spark) == [first.kept]

    def never(*a, **k):
        raise AssertionError("the table was made again")

    other = spark.newSession()
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", never)
    second = build(other, folder)
    assert second.kept == first.kept and sorted(map(tuple, second.baseline.collect())) == rows


def test_changed_input_makes_a_new_table_and_old_ones_go(spark, folder):
    first = build(spark, folder)
    os.utime(f"{folder}/orders.parquet", (1, 1))
    second = build(spark, folder)
    parted = build(spark, folder, partition_by=("room_type",))
    assert len({first.kept, second.kept, parted.kept}) == 3
    assert kept.remove_kept(spark, but=(second.kept,)) == sorted([first.kept, parted.kept])
    assert kept.kept_names(spark) == [second.kept] and second.baseline.count() > 0
    kept.remove_kept(spark)
    assert kept.kept_names(spark) == []


def test_incomplete_table_is_written_again(spark, folder):
    first = build(spark, folder)
    path = kept.scratch_path(spark, f"{kept.FOLDER}/{first.kept}")
    n = first.baseline.count()
    os.remove(f"{path}/_SUCCESS")
    os.remove(next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")))
    assert build(spark, folder).baseline.count() == n


def test_rows_without_files_have_no_fingerprint(spark):
    assert kept.fingerprint(spark.createDataFrame([(1,)], "a int"), ()) is None


def test_scratch_is_removed(spark):
    from staylens.session import file_system, remove_scratch, scratch_path
    own, stays = scratch_path(spark, "scratch-test/a"), scratch_path(spark, "scratch-kept/b")
    for path in (own, stays):
        spark.range(3).write.mode("overwrite").parquet(path)
    others = tuple(p for p in session._SCRATCH[spark.sparkContext.applicationId] if p != own)
    assert remove_scratch(spark, but=others) == [own]
    fs, place = file_system(spark, own)
    assert not fs.exists(place) and fs.exists(file_system(spark, stays)[1])
    assert spark.read.parquet(stays).count() == 3
