"""Tables in the folder that driver and executors share: what is read more than once is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def workdir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, one of our own in a local session, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemill-"))
    return _OWN[0]


def kept(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there: lost executors cost nothing of it."""
    path = f"{workdir(df.sparkSession).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(df: DataFrame, keys: tuple[str, ...] = ("asset", "ts"), buckets: int | None = None) -> DataFrame:
    """``df``, written once as a table in buckets by its keys and sorted by them: joins of such tables on the keys move no row.

    Buckets by all keys are even, also where one series holds most of the rows. Tables meet without an exchange if they have
    equally many buckets (the shuffle partitions of the session, unless given).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemill_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)  # so that a bucket is one file
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{workdir(spark).rstrip('/')}/tidemill-{name}").saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Remove the files of a frame that ``kept`` returned and nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemill-" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
