"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine that names none, as in tests, gets a folder of its own there. Anywhere else a
    local folder would be lost on other executors, so its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths of the tables written and not yet removed.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to a new table in the shared folder and read it back.

    Unlike a local checkpoint the files survive the loss of any executor. They go when the application
    ends, or sooner by ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _hadoop(spark, path)[0].deleteOnExit(_hadoop(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_mark() -> int:
    """How many tables there are: what is written from now on can be dropped by this number."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables that ``materialize`` wrote after mark ``since``, but for the last ``keep``. Nothing lazy may still read them."""
    upto = len(_written) - keep
    for path in _written[since:upto]:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)
    del _written[since:upto]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words of a text in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def with_columns_replaced(df: DataFrame, **new: Column) -> DataFrame:
    """Add columns; an input column of the same name (in any case) gives way."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])
