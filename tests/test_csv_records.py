"""Records of CSV files cut in splits against one task's read of whole files."""

import csv
import os
import random

import pyarrow as pa
import pytest

from staylens.sources import csv_records as cr

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that values and records cross them."""
    keys = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(path, rows, columns=COLUMNS, blank=False):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        for i, r in enumerate(rows):
            out.writerow(r)
            if blank and i % 5 == 0:
                f.write("\n")


def random_rows(seed, n):
    rng = random.Random(seed)
    value = lambda: "".join(rng.choice(['x', 'é', ',', '"', '\n', ' y', 'zz']) for _ in range(
        rng.choice([1, 2, 9, 40]))) + "."
    return [[f"{i}", value(), value()] for i in range(n)]


def whole_files(spark, path):
    got = (spark.read.option("header", True).option("multiLine", True).options(**cr.OPTIONS)
           .csv(path))
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def in_splits(spark, path):
    records, headers = cr.read_records(spark, path)
    return sorted(tuple(r) for r in cr.parsed(records, headers, COLUMNS).collect())


@pytest.mark.parametrize("seed", range(4))
def test_splits_equal_one_task(spark, tmp_path, small_splits, seed):
    path = str(tmp_path / "t.csv")
    write(path, random_rows(seed, 60), blank=seed % 2 == 0)
    records, _ = cr.read_records(spark, path)
    assert records.rdd.getNumPartitions() > 8
    assert in_splits(spark, path) == whole_files(spark, path)


def test_value_over_many_splits_and_files_of_other_orders(spark, tmp_path, small_splits):
    long = "\n".join(f'line "{i}"' for i in range(200))
    rows = [["1", "x", "y"], ["2", long, "z"], ["3", "", "\n"], ["4", "p", "q"]]
    write(tmp_path / "a.csv", rows)
    write(tmp_path / "b.csv", [[r[2], r[0] + "0", "more", r[1]] for r in rows], ["c", "a", "extra", "b"])
    (tmp_path / "empty.csv").write_text("")
    write(tmp_path / "header.csv", [])
    got = in_splits(spark, str(tmp_path))
    want = [tuple(v or None for v in r) for r in rows]
    want += [(r[0] + "0", *w[1:]) for r, w in zip(rows, want)]
    assert got == sorted(want, key=lambda r: r[0]) or sorted(got) == sorted(want)
    write(tmp_path / "c.csv", rows, ["a", "b", "d"])
    with pytest.raises(ValueError, match="c"):
        in_splits(spark, str(tmp_path))


def test_cutter_is_independent_of_batches():
    lines = ['a,b', '1,"x', '', 'y"', '2,z', ' ', '3,"""q"""', '4,"open', 'mid', 'end"', '5,w']
    want = None
    for size in (1, 2, 3, 11):
        cutter = cr.RecordCutter({("f", 0): False}, {"f": 0})
        got = []
        for i in range(0, len(lines), size):
            part = lines[i:i + size]
            batch = pa.record_batch({"value": part, "file": ["f"] * len(part),
                                     "block": pa.array([0] * len(part), pa.int64())})
            for out in cutter.batch(batch):
                got += [r["record"] for r in out.to_pylist()] if not isinstance(out, list) else \
                    [r[1] for r in out]
        assert not cutter.end()
        want = want or sorted(got)
        assert sorted(got) == want == sorted(['1,"x\n\ny"', '2,z', '3,"""q"""', '4,"open\nmid\nend"', '5,w'])
