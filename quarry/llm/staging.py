"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local session gets a temporary one; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it from there: what follows neither repeats the work nor loses it with an executor."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder_ in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder_.startswith(folder(spark)) or folder_.startswith(folder(spark).replace("file://", "file:")):
            at = jvm.org.apache.hadoop.fs.Path(folder_)
            at.getFileSystem(conf).delete(at, True)


def carried(docs: DataFrame) -> DataFrame:
    """docs as one column, row, of all their columns: no name of theirs can clash with one that an operator adds."""
    return docs.select(F.struct("*").alias("row"))


def with_text(text, docs: DataFrame) -> list:
    """The columns of the carried docs, with another text."""
    return [text.alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns]
