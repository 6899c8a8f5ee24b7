"""Where a run may put shared, durable intermediate tables."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Applications whose executors have the package.
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it and it would be lost with the machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="evalspark-"))
    return context.getCheckpointDir()


def stage(table: DataFrame, spark: SparkSession) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps then reread it instead of computing it again, also after an
    executor is lost, and plan with its true size.
    """
    path = f"{shared_dir(spark)}/stage/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go when it is, not some time later."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents by hash of their key, in as many partitions as a shuffle has.

    Text grows a lot when it is cut into chunks and words, so it is moved once
    before that; all later work per chunk then stays in its partition. A fixed
    count keeps AQE from merging partitions by their size before they grow.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(count, key)


def ship(spark: SparkSession, *modules: str) -> None:
    """Give this package, and single-file ``modules``, to the executors; once per session.

    Not needed where they have it installed or get it by ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="evalspark-"), "package")
    context.addPyFile(
        shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    )
    for module in modules:
        context.addPyFile(module)
    _SHIPPED.add(context.applicationId)

