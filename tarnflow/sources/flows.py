"""Flows as long tables: (site, ts, q), and (realization, site, ts, q) for ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW = T.StructType([T.StructField("site", T.StringType()), T.StructField("ts", T.DateType()), T.StructField("q", T.DoubleType())])


def validated(flow: DataFrame) -> DataFrame:
    """flow with its columns cast to the schema; TypeError for what is no DataFrame, ValueError where columns lack."""
    if not isinstance(flow, DataFrame):
        raise TypeError("flow must be a DataFrame")
    missing = {"ts", "q"} - set(flow.columns)
    if missing:
        raise ValueError(f"flow lacks {sorted(missing)}")
    if "site" not in flow.columns:
        flow = flow.withColumn("site", F.lit("flow"))
    keys = [c for c in ("realization",) if c in flow.columns]
    q = F.col("q").cast("double")
    return flow.select(*keys, F.col("site").cast("string").alias("site"), F.col("ts").cast("date").alias("ts"), F.when(~F.isnan(q), q).alias("q"))


def read_wide_csv(spark: SparkSession, path: str, date_column: str | None = None, first_day: str | None = None) -> DataFrame:
    """A wide CSV (a date column, then one column a site) as a long flow.

    With first_day, dates are dealt by row position from that day on and the file's own date text is dropped: the file is
    then one day a row in file order.
    """
    wide = spark.read.csv(path, header=True, inferSchema=False)
    date_column = date_column or wide.columns[0]
    sites = [c for c in wide.columns if c != date_column]
    if first_day:
        wide = in_file_order(wide)
        ts = F.date_add(F.lit(first_day).cast("date"), F.col("_row").cast("int"))
    else:
        ts = F.to_date(F.col(date_column))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.col(f"`{s}`").cast("double").alias("q")) for s in sites]))
    return wide.withColumn("_ts", ts).select(F.col("_ts").alias("ts"), cells.alias("c")).select("c.site", "ts", "c.q")


def in_file_order(read: DataFrame) -> DataFrame:
    """Rows straight from a file reader with _row, their number from 0 in the order of files and of lines inside them.

    Two passes: the first counts the rows of each split of a file; a split's rows go on from those of the splits ahead of it,
    and a row's place in its split is its scan position. No row moves for this, only one count a split.
    """
    at = read.withColumn("_file", F.col("_metadata.file_path")).withColumn("_start", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
    splits = at.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a split
    shift = splits.select("_file", "_start", (ahead - F.col("_first")).alias("_shift"))
    return at.join(shift, ["_file", "_start"]).withColumn("_row", F.col("_at") + F.col("_shift")).drop("_file", "_start", "_at", "_shift")


def write_wide_csv(flow: DataFrame, path: str) -> None:
    """One row a date, one column a site, in date order."""
    flow.groupBy("ts").pivot("site").agg(F.sum("q")).orderBy("ts").write.csv(path, header=True)


def write_ensemble(ensemble: DataFrame, path: str, by: str = "realization") -> None:
    """Parquet with one folder a realization (or site), so that reading one prunes the others."""
    ensemble.repartition(by).write.partitionBy(by).parquet(path)


def realization_numbers(ensemble: DataFrame) -> DataFrame:
    """The distinct realizations; `realization_7` is 7, other text and whole numbers stay; ValueError for labels of any other type."""
    kind = dict(ensemble.dtypes)["realization"]
    if kind not in ("string", "tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"realizations are text or whole numbers, not {kind}")
    name = F.col("realization").cast("string")
    number = F.regexp_extract(name, r"^realization_(\d+)$", 1)
    return ensemble.select(F.when(number != "", number).otherwise(name).alias("realization")).distinct()


def read_ensemble(spark: SparkSession, path: str, realizations: list[int] | None = None) -> DataFrame:
    """An ensemble, or the wanted realizations of it, renumbered from 0 by their order; ValueError if one is not there."""
    return subset_renumbered(spark.read.parquet(path), realizations)


def subset_renumbered(ensemble: DataFrame, realizations: list[int] | None = None) -> DataFrame:
    there = ensemble.select("realization").distinct()
    if realizations is not None:
        absent = set(realizations) - {r.realization for r in there.where(F.col("realization").isin(realizations)).collect()}
        if absent:
            raise ValueError(f"no realization {sorted(absent)}")
        there = there.where(F.col("realization").isin(realizations))
        ensemble = ensemble.where(F.col("realization").isin(realizations))
    number = there.select("realization", (F.row_number().over(Window.orderBy("realization")) - 1).alias("number"))  # one row a realization
    return ensemble.join(number, "realization").withColumn("realization", F.col("number")).drop("number")


def days(first: str, last: str) -> F.Column:
    """An array of all days from first to last."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))


def densified(flow: DataFrame, first: str | None = None, last: str | None = None, fill: float | None = 0.0) -> DataFrame:
    """Every site on every day of the range, by default from the flow's first to its last day; missing values become fill."""
    ends = flow.groupBy("site").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    whole = Window.partitionBy()  # one row a site
    low = F.min("_a").over(whole) if first is None else F.lit(first).cast("date")
    high = F.max("_b").over(whole) if last is None else F.lit(last).cast("date")
    spine = ends.select("site", low.alias("_a"), high.alias("_b")).select("site", F.explode(F.sequence("_a", "_b")).alias("ts"))
    out = spine.join(flow, ["site", "ts"], "left")
    return out.withColumn("q", F.coalesce("q", F.lit(fill))) if fill is not None else out


def gauges_with_long_records(flow: DataFrame, first_year: int) -> DataFrame:
    """Drops days on which every site is missing, then sites whose first value is later than first_year."""
    day_ok = flow.groupBy("ts").agg(F.count("q").alias("n")).where("n > 0").select("ts")
    site_ok = flow.where("q IS NOT NULL").groupBy("site").agg(F.min(F.year("ts")).alias("y")).where(F.col("y") <= first_year).select("site")
    return flow.join(day_ok, "ts", "left_semi").join(site_ok, "site", "left_semi").select("site", "ts", "q")


def marginal_inflow(flow: DataFrame, edges: DataFrame) -> DataFrame:
    """q less the flows of the sites directly upstream; edges: (upstream, downstream)."""
    above = edges.join(flow.select(F.col("site").alias("upstream"), "ts", "q"), "upstream").groupBy(F.col("downstream").alias("site"), "ts").agg(F.sum("q").alias("above"))
    return flow.join(above, ["site", "ts"], "left").select("site", "ts", (F.col("q") - F.coalesce("above", F.lit(0.0))).alias("q"))
