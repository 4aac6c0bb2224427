"""Runtime controls: log level, cores and the seed that seeded operators take by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SEED = 0


def session(cores: int | None = None, verbose: bool = False, memory: str = "8g", **conf) -> SparkSession:
    """A local session with the engine's settings, or the active one."""
    builder = SparkSession.builder.master(f"local[{cores or '*'}]").config("spark.driver.memory", memory).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    set_verbosity(spark, verbose)
    return spark


def set_verbosity(spark: SparkSession, verbose: bool) -> None:
    spark.sparkContext.setLogLevel("INFO" if verbose else "ERROR")


def set_seed(seed: int) -> None:
    global _SEED
    _SEED = seed


def seed() -> int:
    return _SEED


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which every executor sees.

    Only in local mode, where that is unset, a folder of this machine takes its place.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> str:
    """Save a table (motifs, a model, a result); returns its path."""
    df.write.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
