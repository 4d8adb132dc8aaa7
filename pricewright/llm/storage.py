"""Places that the driver and every executor can read: reliable checkpoints and stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only,
    since a cluster's executors don't share the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not folder and not held and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = held or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if held is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files at its end: its result is in the shared folder then."""
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


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@dataclass(frozen=True)
class Stored:
    """A stage's rows as Parquet in the shared folder, until they are dropped."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; nothing that is still to run may read them."""
        spark = self.frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> Stored:
    """Write a stage's rows as Parquet in the shared folder, to be dropped when others replace them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return Stored(spark.read.parquet(path), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows as Parquet in the shared folder and read them back."""
    return stored(df, name).frame


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` is, in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the filter that goes before a join with few of the documents; a fixed 1 MB.
FILTER_BITS = 1 << 23


def narrowed(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids`` (node): all that are, and few others.

    A broadcast bitmap of fixed size, so that a join with part of the documents needn't shuffle
    the texts of the rest; with very many ids it passes more, and the join does all the work.
    With ``inside`` false, the other rows, none of which is in ``ids``.
    """
    place = F.pmod("node", F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(node, {FILTER_BITS}) % 64 as int))")
    bitmap = ids.groupBy(F.floor(place / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    word = F.floor(F.pmod("doc_id", F.lit(FILTER_BITS)) / 64)
    hit = F.expr(f"(shiftrightunsigned(_bits, cast(pmod(doc_id, {FILTER_BITS}) % 64 as int)) & 1L) = 1L")
    return docs.join(F.broadcast(bitmap), (word == F.col("_word")) & hit, "left_semi" if inside else "left_anti")
