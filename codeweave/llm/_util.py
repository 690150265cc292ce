"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form
#: feed and carriage return.  bytes.split() splits at just these six.
WORD = r"[^\x20\x09-\x0D]+"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder of ``spark.checkpoint.dir``, which all executors must share.

    Only a local session, where all is one machine, gets a folder of its own if none is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweave-checkpoint-"))
    return df.checkpoint(eager=True)


def few_files(df: DataFrame) -> DataFrame:
    """Narrow rows dealt into partitions of the advisory size, not one for each task before.

    A checkpoint writes a file for each partition, and without Hadoop's native library executors start two processes
    for each file (its permissions and its checksum's).
    """
    return df.hint("rebalance")


def shared(df: DataFrame, model: object) -> Callable[[], object]:
    """A function that gives executors the model.

    Its contents are broadcast as plain arrays and its class travels with the
    function, so that executors need no installed copy of either.
    """
    kind, contents = type(model), df.sparkSession.sparkContext.broadcast(model.__dict__)

    def get() -> object:
        out = kind.__new__(kind)
        out.__dict__.update(contents.value)
        return out

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text):
    """Number of words as a column; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows: about ``each`` a partition, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // each))


def fresh(name: str, taken) -> str:
    """``name``, lengthened until it is not among the names that are taken (letter case aside)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, hot: int = 4096) -> DataFrame:
    """``rows`` joined with ``table`` (a row for each key, and how many of ``rows`` have it) by ``key``, without gathering a hot key in a task.

    Keys with more than 1 / ``hot`` of all rows, which are fewer than ``hot``, are broadcast; the others are joined by
    shuffle.  Both frames should be checkpointed, as they are read twice.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    many = F.broadcast(table.where(F.col(count) * hot > total))
    few = table.where(F.col(count) * hot <= total)
    rest = rows.join(many.select(key), key, "left_anti").join(few, key)
    return rows.join(many, key).unionByName(rest)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` checkpointed, and marked for broadcast if it has at most ``most`` rows."""
    df = durable(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
