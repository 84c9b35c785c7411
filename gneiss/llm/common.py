"""What the operators share: reading a table, cutting lineage, ASCII rules for text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space of the text contracts: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    if not (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not (named := sc.getConf().get("spark.checkpoint.dir")) and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gneiss-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_print(df: DataFrame) -> Column:
    """A fingerprint of all columns of a row; a null differs from what is absent elsewhere."""
    of = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
    return F.xxhash64(*[x for f in df.schema.fields for x in (of(f), F.col(f"`{f.name}`").isNull())])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns that also replaces input columns whose names differ only by case."""
    names = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])
