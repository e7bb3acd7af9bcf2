"""Cutting a plan where many later ones read its result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows in memory, as a broadcast would have them, for each byte of a checkpoint's files, which are compressed.
PACKED = 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. In local mode, as in tests, one of our own where none is named; on a
    cluster that is an error, as executors wouldn't see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="prismara-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the session ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/prismara-{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within go as soon as it has run, and not when the driver happens to
    collect its garbage. For what is written and then read from there, as no plan runs twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def sized(df: DataFrame) -> DataFrame:
    """df, which a checkpoint has given, with an estimate of its size by its files.

    A checkpoint hands on the estimate of the plan that made it, in which a join multiplies those of its sides. Over rounds
    of joins and checkpoints the estimate's digits so grow by a factor each round, until the driver's memory and time go to
    this number alone; and what comes out of Python or a generator is estimated too low.
    """
    context, query = df.sparkSession.sparkContext, df._jdf.queryExecution()
    jvm, plan = context._jvm, query.analyzed()
    file = plan.rdd().getCheckpointFile()
    if file.isEmpty():
        return df
    where = jvm.org.apache.hadoop.fs.Path(file.get())
    size = where.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(where).getLength() * PACKED
    # A plan of known size, as Python can't hand on the number itself.
    like = df.sparkSession.range(-(-max(size, 1) // 8)).select("id")._jdf.queryExecution().analyzed().stats()
    some, none = jvm.scala.Option.apply, jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, query.sparkSession(), some(like), some(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(query.sparkSession(), plan), df.sparkSession)


def settled(df: DataFrame) -> DataFrame:
    """df computed once, by a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df's was made with the setting as it was then
