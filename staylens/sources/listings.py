"""Listing sources: the CSV dump (text prices) and a star view over TPC-H tables.

Every reader returns the canonical listing schema :data:`LISTINGS_SCHEMA`; bad
*values* become null per row (never a failed load), NaN becomes null.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.expressions import nan_to_null
from staylens.operators.skew import attach_key_count
from staylens.sources import csv_records

LISTINGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("host_id", T.LongType()),
    T.StructField("host_name", T.StringType()),
    T.StructField("neighbourhood_group", T.StringType()),
    T.StructField("neighbourhood", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("room_type", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("minimum_nights", T.IntegerType()),
    T.StructField("number_of_reviews", T.LongType()),
    T.StructField("last_review", T.DateType()),
    T.StructField("reviews_per_month", T.DoubleType()),
    T.StructField("calculated_host_listings_count", T.LongType()),
    T.StructField("availability_365", T.IntegerType()),
])

_DOUBLE_COLUMNS = ("latitude", "longitude", "price", "reviews_per_month")


def parse_price(c: str | Column = "price") -> Column:
    """``$1,234.00`` -> 1234.0; numbers pass through; bad text or NaN -> null."""
    x = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(x.cast("string"), r"[$,]", "")
    return nan_to_null(text.try_cast("double"))


#: Tried in this order after ISO dates and times; of two readings the month is first.
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "yyyyMMdd", "MMM d, yyyy",
                "MMMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy")


def parse_date(c: str | Column) -> Column:
    """Text in ISO form or one of ``DATE_FORMATS`` to a date; other text -> null."""
    x = F.col(c) if isinstance(c, str) else c
    text = F.trim(x.cast("string"))
    return F.coalesce(text.try_cast("date"), *[
        F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def conform(raw: DataFrame) -> DataFrame:
    """Text columns (as read from a listings dump) to :data:`LISTINGS_SCHEMA`.

    Values are converted with ``try_cast``, so an unparsable value is null for
    that row only. Prices accept ``$`` and thousands separators, dates several
    formats (:func:`parse_date`). Extra columns are ignored; a missing one raises.
    """
    missing = [f.name for f in LISTINGS_SCHEMA.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"listings without the columns {missing}")
    cols = []
    for f in LISTINGS_SCHEMA.fields:
        if f.name == "price":
            cols.append(parse_price("price").alias("price"))
        elif f.name == "last_review":
            cols.append(parse_date(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(nan_to_null(F.col(f.name).try_cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


COLUMNS = [f.name for f in LISTINGS_SCHEMA.fields]
TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_listings_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scan listing CSV files (header row, quoted fields) and conform them to the
    listing schema (:func:`conform`).

    Columns are found by the names in each file's own header, so files may have them in
    different orders; a file without one of the columns raises.  ``multi_line`` is for
    dumps with line breaks inside quotes; large files are split either way
    (:mod:`csv_records`).
    """
    if multi_line:
        records, headers = csv_records.read_records(spark, path)
        return conform(csv_records.parsed(records, headers, COLUMNS))
    files: dict[str, list[str]] = {}
    for file, line in sorted(csv_records.file_headers(spark, path).items()):
        files.setdefault(line, []).append(file)
    reader = spark.read.option("header", True).options(**csv_records.OPTIONS)
    if not files:
        return spark.createDataFrame([], LISTINGS_SCHEMA)
    if len(files) == 1:      # one header: one scan of the path as given
        return conform(reader.option("enforceSchema", False).csv(path))
    return reduce(DataFrame.union, [conform(reader.csv(group)) for group in files.values()])


def read_tpch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def points_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of points of interest, one per customer: poi_id, latitude, longitude."""
    k = F.col("c_custkey")
    return read_tpch(spark, sf_dir, "customer").select(
        k.cast("long").alias("poi_id"),
        (F.lit(-22.91) - ((k * 37) % 1901) / F.lit(10000.0)).alias("latitude"),
        (F.lit(-43.11) - ((k * 101) % 5407) / F.lit(10000.0)).alias("longitude"))


def listings_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing star view over orders, customer, nation, region and lineitem.

    One listing per order.  Shape of the plan at scale:

    * ``lineitem`` is pre-aggregated per order (partial aggregation before the
      shuffle), and the join with ``orders``, still narrow, reuses that hash partitioning;
    * ``nation`` and ``region`` are dimension tables - left to the planner's
      size-checked automatic broadcast - and join ``customer``, the smaller side, first;
    * ``orders`` joins ``customer`` on the customer key (shuffle join; AQE may
      turn it into a broadcast when the runtime size is small);
    * the per-host listing count is a ``groupBy(host_id).count()`` joined back,
      not a window, with hot hosts salted (:func:`attach_key_count`): a host
      holding a third of all rows is spread over many join tasks instead of
      landing whole in one.  Columns that follow from an order's own are computed
      after that join, so that its shuffle does not carry them.
    """
    orders = read_tpch(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_tpch(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_tpch(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_tpch(spark, sf_dir, "region").select("r_regionkey", "r_name")
    li = (read_tpch(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("li_n"), F.sum("l_quantity").alias("li_q")))

    hosts = (customer
             .join(nation, customer.c_nationkey == nation.n_nationkey)
             .join(region, F.col("n_regionkey") == region.r_regionkey))
    base = (orders
            .join(li, orders.o_orderkey == li.l_orderkey, "left")
            .join(hosts, F.col("o_custkey") == hosts.c_custkey))

    k = F.col("o_orderkey")
    host_id = (F.when(k % 5 == 0, F.lit(10000000) + k)
               .when(k % 5 == 1, F.lit(20000000) + F.floor(k / F.lit(15.0)).cast("long"))
               .when(k % 5 == 2, F.lit(30000000) + F.col("n_nationkey"))
               .otherwise(F.col("o_custkey").cast("long"))).cast("long")
    odate = F.col("o_orderdate")
    last_review = (F.when(k % 10 == 0, F.lit(None).cast("date"))
                   .when((F.year(odate) == 1998) & F.month(odate).isin(6, 7),
                         F.lit(None).cast("date"))
                   .otherwise(odate.cast("date")))
    price_div = F.when(k % 50 == 0, F.lit(32)).otherwise(F.lit(400))

    hosted = attach_key_count(
        base.select("o_orderkey", host_id.alias("host_id"), "c_name", "r_name", "n_name",
                    "o_orderpriority", "o_totalprice", "o_orderdate", "li_n", "li_q"),
        "host_id", "calculated_host_listings_count", salt_col="o_orderkey")
    return hosted.select(
        k.alias("id"),
        F.concat(F.lit("Listing "), k.cast("string")).alias("name"),
        F.col("host_id"),
        F.col("c_name").alias("host_name"),
        F.col("r_name").alias("neighbourhood_group"),
        F.col("n_name").alias("neighbourhood"),
        (F.lit(-22.95) - (k % 100) / F.lit(1000.0)).alias("latitude"),
        (F.lit(-43.17) - ((k * 7) % 400) / F.lit(1000.0)).alias("longitude"),
        F.col("o_orderpriority").alias("room_type"),
        (F.col("o_totalprice") / price_div).cast("double").alias("price"),
        ((k * 13) % 45).cast("int").alias("minimum_nights"),
        F.coalesce(F.col("li_q"), F.lit(0.0)).cast("long").alias("number_of_reviews"),
        last_review.alias("last_review"),
        (F.col("li_n") / F.lit(4.0)).alias("reviews_per_month"),
        F.col("calculated_host_listings_count"),
        ((k * 37) % 366).cast("int").alias("availability_365"),
    )
