"""Tick and bar views over the driver's tables, and files of bars."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.bars import validate
from tidemill.operators.events import Scale
from tidemill.operators.order import running_total
from tidemill.session import table

BAR_SCHEMA = T.StructType([T.StructField("Datetime", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close"))])
#: Columns of a vendor file, and what stands in for those that it may lack.
STANDARD = ("DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "TICKVOL", "VOL", "SPREAD")
DEFAULTS = {"TICKVOL": 1, "VOL": 1_000_000, "SPREAD": 0}


def ticks(spark: SparkSession, sf_dir: str, assets: bool = False) -> DataFrame:
    """``asset, ts, event_id, price``: a walk over the events, of all together or of each event type."""
    events = table(spark, sf_dir, "events")
    asset = F.col("event_type") if assets else F.lit("ALL")
    rows = events.select(asset.alias("asset"), "ts", "event_id", (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("step"))
    walked = running_total(rows, F.col("step"), "level", order=("ts", "event_id"))
    return walked.select("asset", "ts", "event_id", (1000.0 * F.exp(1e-7 * F.col("level"))).alias("price"))


def minute_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a CSV file with header ``Datetime,Open,High,Low,Close``; of equal times the first row of the file stays."""
    rows = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    placed = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    first = placed.groupBy("Datetime").agg(F.min_by(F.struct("Open", "High", "Low", "Close"), "_at").alias("bar"))
    return first.select(F.col("Datetime").alias("ts"), *[F.col(f"bar.{c}").alias(c.lower()) for c in ("Open", "High", "Low", "Close")])


def separator(spark: SparkSession, path: str) -> str:
    """Comma, or tab where the first line has no comma."""
    line = spark.read.text(path).limit(1).collect()
    return "," if line and "," in line[0].value else "\t"


def vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a vendor file: separator found, header in capitals without brackets, missing volumes filled, extra columns dropped."""
    raw = spark.read.option("header", True).option("sep", separator(spark, path)).csv(path)
    named = raw.toDF(*[c.strip().strip("<>").upper() for c in raw.columns])
    filled = named.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in named.columns})
    kinds = {**dict.fromkeys(("OPEN", "HIGH", "LOW", "CLOSE"), "double"), **dict.fromkeys(DEFAULTS, "bigint")}
    return filled.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in STANDARD])


def vendor_folder(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all vendor files below a path in one scan: ``asset, file``, the standard columns, and ``bad``.

    Each file has a separator (comma or tab) and a header of its own, which one row a file carries to its lines; its name up to
    the first ``_`` or ``.`` is the asset. ``bad`` holds the line where it has another number of cells than its header or a cell
    that is none of its kind, and is NULL elsewhere; a file without a header gives bad lines alone. Empty lines are left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    is_head = F.upper("value").rlike(r"^[\s\ufeff]*<?DATE>?[,\t]")
    heads = lines.where(is_head).groupBy("file").agg(F.min("value").alias("_head"))
    cut = lambda x, head: F.when(head.contains(","), F.split(x, ",")).otherwise(F.split(x, "\t"))
    names = F.transform(cut(F.col("_head"), F.col("_head")), lambda x: F.upper(F.regexp_replace(x, r"[\s<>\ufeff]", "")))
    rows = lines.where(~is_head).join(heads.withColumn("_names", names), "file", "left").withColumn("_cells", cut(F.col("value"), F.col("_head")))
    kinds = {**dict.fromkeys(("OPEN", "HIGH", "LOW", "CLOSE"), "double"), **dict.fromkeys(DEFAULTS, "bigint")}

    def column(name: str) -> Column:
        at = F.array_position("_names", F.lit(name))
        cell = F.when(at > 0, F.trim(F.get("_cells", (at - 1).cast("int"))))
        kept = cell.try_cast(kinds[name]) if name in kinds else cell
        return F.when(at == 0, F.lit(DEFAULTS[name]).cast("bigint")).otherwise(kept) if name in DEFAULTS else kept

    found = rows.select("value", "file", F.regexp_extract("file", r"([^/_.]+)[^/]*$", 1).alias("asset"), (F.size("_cells") == F.size("_names")).alias("_whole"), *[column(c).alias(c) for c in STANDARD])
    good = F.coalesce(F.col("_whole"), F.lit(False)) & functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in STANDARD])
    return found.select("asset", "file", *STANDARD, F.when(~good, F.col("value")).alias("bad"))


def scales(spark: SparkSession, path: str) -> list[Scale]:
    """The sampler's scales from a JSON file: names to ``theta_base``, ``window`` and ``lambda_aggression``."""
    whole = spark.read.text(path, wholetext=True).first()
    return [Scale.of(name, own) for name, own in json.loads(whole.value).items()] if whole else []


def with_time(vendor: DataFrame) -> DataFrame:
    """Vendor bars with one time column ``ts``."""
    ts = F.try_to_timestamp(F.concat_ws(" ", "DATE", "TIME"), F.lit("yyyy.MM.dd HH:mm:ss")).cast("timestamp_ntz")
    return vendor.select(ts.alias("ts"), *[F.col(c).alias(c.lower()) for c in STANDARD[2:]])


def between_days(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Rows from the day ``start`` to the end of the day ``end``."""
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df.where(F.col(ts) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")) if end else df


def model_files(spark: SparkSession, folder: str, prefix: str = "regime_probs_max_dc_train_") -> DataFrame:
    """All rows of the model files in a folder, with the model's name from the file's."""
    rows = spark.read.parquet(f"{folder}/{prefix}*.parquet")
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), f"{prefix}([^/]+?)\\.parquet", 1))


def require(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks or has with another type (``numeric`` stands for any number)."""
    found = dict(df.dtypes)
    missing = [c for c in kinds if c not in found]
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    wrong = [f"{c}: {found[c]}" for c, k in kinds.items() if c in found and found[c] != k and not (k == "numeric" and (found[c] in numbers or found[c].startswith("decimal")))]
    if missing or wrong:
        raise ValueError(f"missing columns: {missing}; columns of another type: {wrong}")
    return df


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """An error that names the paths which don't exist."""
    absent = [p for p in paths if not _exists(spark, p)]
    if absent:
        raise FileNotFoundError(", ".join(absent))


def remapped(df: DataFrame, ts: str, price: str) -> DataFrame:
    """The time and price columns by the names that the events are sampled from."""
    return require(df, {ts: dict(df.dtypes).get(ts, ""), price: "numeric"}).select(F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(price).cast("double").alias("close"))


def converted(spark: SparkSession, path: str, out: str, asset: str) -> dict[str, int]:
    """A vendor's CSV file as Parquet bars: columns checked, all rows validated, counts read back; the violations by kind.

    A file without rows, or with rows that have no time or price, is an error, and nothing is written.
    """
    require_paths(spark, [path])
    bars = with_time(vendor_csv(spark, path)).withColumn("asset", F.lit(asset))
    require(bars, {"ts": "timestamp_ntz", **dict.fromkeys(("open", "high", "low", "close", "tickvol", "vol", "spread"), "numeric")})
    found = validate(bars).first().asDict()
    if not found["n_rows"] or found["n_null"]:
        raise ValueError(f"{path}: {found['n_rows']} rows, {found['n_null']} without time or price")
    write_bars(bars, out)
    return found


def write_signatures(found: DataFrame, path: str, rows_a_file: int = 50_000) -> DataFrame:
    """Signatures in files of so many rows at most, by series and scale; reads them back."""
    found.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("asset", "scale").parquet(path)
    return found.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def write_bars(df: DataFrame, path: str, rows_a_file: int = 1_000_000) -> DataFrame:
    """Write partitioned by asset, then read back and compare the counts."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("asset").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.count() != df.count() or set(back.columns) != set(df.columns):
        raise ValueError(f"{path} does not hold what was written")
    return back


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at ``path``, built and written first where no finished write is there or ``force`` is set."""
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
