"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch: texts may be long, and a task holds a batch several times over.
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows (they are cut when a plan runs, so it stays set)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``; one of our own only in local mode where that is unset.

    On a cluster other executors can't see a folder of this machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get().rsplit("/", 1)[0] if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def remove(path: str) -> None:
    fs, at = open_fs(path)
    if fs.get_file_info(at).type.name == "Directory":
        fs.delete_dir(at)


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def save(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts the lineage, survives lost executors."""
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns as one struct, so that no name of theirs can meet one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


#: Rows of a small-rowed table to a file and a task.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most about ``rows`` small rows, in as many partitions as they need."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Memo(dict):
    """A bounded memo in two generations: when one is full it becomes the old one, whose entries come back as they are used."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
            if len(key) > 64:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
