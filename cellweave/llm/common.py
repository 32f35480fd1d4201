"""Helpers shared by the corpus operators: reading, shared storage, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, a folder of our own, but only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later plans start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neutral(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., whatever they are called."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def restored(out: DataFrame, columns: list[str], results: tuple[str, ...]) -> DataFrame:
    """c0, c1, ... under their names again, then the results r_*; one whose name is taken gets underscores."""
    taken, named = {c.lower() for c in columns}, []
    for r in results:
        name = r
        while name.lower() in taken:
            name += "_"
        named.append(F.col(f"r_{r}").alias(name))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *named)


def whole(text: Column | str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words between white space, in order; none for an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def constant_array(values: list[float]) -> Column:
    """A bounded list of doubles as one literal, folded before execution."""
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")


def held_arrays(spark: SparkSession, rows: list[list[float]]) -> list[Column]:
    """Bounded lists of doubles, each read from a one-row table by a scalar subquery.

    A literal's values are written out in every description of the plan that
    Spark's listeners keep, at each step of adaptive execution again.
    """
    table = spark.createDataFrame(pa.table({f"a{i}": pa.array([r], pa.list_(pa.float64())) for i, r in enumerate(rows)}))
    return [table.select(c).scalar() for c in table.columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
