"""CSV files as records: values with line breaks in large files, and files whose columns
stand in different orders.

A line break is part of a value if an odd number of quotes precedes it in its file.
So the quotes of each *split* are counted first (one scan, no parsing); their parities,
xor-ed along each file, say for every split whether it begins inside a value.  Then each
task cuts its own split into records.  Only the record that crosses a split's end
is put together elsewhere, from at most two fragments a split.  Any number of tasks
read one file.

Headers are read file by file, and every file's records are taken apart by its own header.

What reaches the driver is a row per split and a header per file; what is broadcast is a
flag per split and a number per file.

Defined cases: quotes stand around whole values and are doubled inside them (a stray quote in
an unquoted value would shift the count); a line break inside a value reads as ``\\n``;
blank lines between records are skipped; files without a line have no records; a header
with a line break raises.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.session import ship_code

QUOTE = '"'
#: How Spark reads one record; the same for whole files and for single records.
OPTIONS = {"escape": QUOTE, "mode": "PERMISSIVE"}
WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3      # a record, or a fragment of one

_CUT = pa.schema([("header", pa.int32()), ("record", pa.string()), ("file", pa.string()),
                  ("block", pa.int64()), ("kind", pa.int32())])
_CUT_DDL = "header int, record string, file string, block long, kind int"


def header_names(line: str) -> list[str]:
    """Column names of a header line."""
    return next(csv.reader([line.lstrip("﻿")]), [])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"))


def file_headers(spark: SparkSession, path: str) -> dict[str, str]:
    """The first line of each file that has one."""
    lines = _lines(spark, path).withColumn("nth", F.monotonically_increasing_id())
    return {r["file"]: r["line"] for r in lines.where("block = 0").groupBy("file").agg(
        F.min_by("value", "nth").alias("line")).collect()}


def _splits(spark: SparkSession, path: str) -> list:
    """(file, block, odd, line) of every split: whether its quotes are odd in number, and the
    first line where it is a file's first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    line = F.min_by(F.when(F.col("block") == 0, F.col("value")), "nth")
    return (_lines(spark, path).withColumn("nth", F.monotonically_increasing_id())
            .groupBy("file", "block")
            .agg((F.sum(quotes) % 2 == 1).alias("odd"), line.alias("line")).collect())


class RecordCutter:
    """Cuts the lines of splits, given in order, into records and fragments."""

    def __init__(self, begins_open: dict[tuple[str, int], bool], header_of: dict[str, int]):
        self.begins_open, self.header_of = begins_open, header_of
        self.place: tuple[str, int] | None = None
        self.open = self.started = False
        self.held: list[str] = []

    def _row(self, kind: int) -> tuple:
        row = (self.header_of[self.place[0]], "\n".join(self.held), *self.place, kind)
        self.held, self.started = [], False
        return row

    def end(self) -> list[tuple]:
        """What is open where a split ends."""
        return [self._row(TAIL if self.started else THROUGH)] if self.held else []

    def batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch | list[tuple]]:
        files = batch.column("file").dictionary_encode()
        code = files.indices.to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        odd = pc.count_substring(batch.column("value"), QUOTE).to_numpy(zero_copy_only=False) % 2
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
            place = (files.dictionary[int(code[a])].as_py(), int(block[a]))
            lines = batch.column("value").slice(a, b - a)
            yield from self._run(place, lines, odd[a:b])

    def _run(self, place: tuple[str, int], lines: pa.Array, odd: np.ndarray):
        fresh = place != self.place
        if fresh:
            yield self.end()
            self.place, self.open = place, self.begins_open[place]
        inside = (np.cumsum(odd) - odd + self.open) % 2 == 1     # where each line begins
        alone = ~inside & (odd == 0)
        keep = alone & (pc.utf8_length(pc.utf8_trim_whitespace(lines)).to_numpy(
            zero_copy_only=False) > 0)
        if fresh and place[1] == 0:
            alone[0], keep[0] = True, False                      # the header
        whole = lines.filter(pa.array(keep))
        n = len(whole)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.header_of[place[0]], np.int32)), whole,
             pa.array([place[0]] * n, pa.string()), pa.array(np.full(n, place[1], np.int64)),
             pa.array(np.zeros(n, np.int32))], schema=_CUT)
        rows = []
        for i in np.flatnonzero(~alone).tolist():
            self.started = self.started or not inside[i]
            self.held.append(lines[i].as_py())
            if odd[i] and inside[i]:
                rows.append(self._row(WHOLE if self.started else HEAD))
        yield rows
        self.open = bool((int(odd.sum()) + self.open) % 2)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(header, record): each record's text and the number of its file's header; and the
    header lines."""
    state: dict[tuple[str, int], bool] = {}
    by_file = defaultdict(list)
    headers: dict[str, str] = {}
    for r in _splits(spark, path):
        by_file[r["file"]].append((r["block"], r["odd"]))
        if r["block"] == 0:
            headers[r["file"]] = r["line"]
    for file, splits in by_file.items():
        open_ = False
        for block, odd in sorted(splits):
            state[file, block] = open_
            open_ ^= odd
    lines = sorted(set(headers.values()))
    if any(line.count(QUOTE) % 2 for line in lines):
        raise ValueError("a header with a line break")
    header_of = {f: lines.index(h) for f, h in headers.items()}
    sent = spark.sparkContext.broadcast((state, header_of))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = RecordCutter(*sent.value)
        for out in _each(cutter, batches):
            if isinstance(out, list):
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)
            elif out.num_rows:
                yield out

    def _each(cutter, batches):
        for batch in batches:
            if batch.num_rows:
                yield from cutter.batch(batch)
        yield cutter.end()

    ship_code(spark)
    found = _lines(spark, path).mapInArrow(cut, _CUT_DDL)
    whole = found.where(F.col("kind") == WHOLE).select("header", "record")
    if not any(state.values()):
        return whole, lines
    # a record that crosses splits: its tail, whole splits inside it, and its head
    in_file = Window.partitionBy("file").orderBy("block", "kind")
    pieces = found.where(F.col("kind") != WHOLE).withColumn(
        "nth", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(in_file))
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    joined = pieces.groupBy("file", "nth").agg(
        F.first("header").alias("header"),
        F.concat_ws("\n", F.transform(ordered, lambda p: p["record"])).alias("record"))
    return whole.union(joined.select("header", "record")), lines


def parsed(records: DataFrame, headers: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The named columns of records as text, each taken by its file's own header; a header
    without one of them raises."""
    structs: list[Column] = []
    for number, line in enumerate(headers):
        names = header_names(line)
        if missing := [c for c in columns if c not in names]:
            raise ValueError(f"a file without the columns {missing}")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        values = F.from_csv("record", F.lit(schema.simpleString()[7:-1].replace(":", " ")), OPTIONS)
        structs.append(F.when(F.col("header") == number, F.struct(*[
            values[f"c{names.index(c)}"].alias(c) for c in columns])))
    if not structs:
        return records.select(*[F.lit(None).cast("string").alias(c) for c in columns]).limit(0)
    return records.select(F.coalesce(*structs).alias("r")).select("r.*")
