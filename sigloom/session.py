"""Session and table helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sigloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a local session only, one of our own where it is unset (tests)."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        _own.append(tempfile.mkdtemp(prefix="sigloom-"))
        path = f"file://{_own[-1]}"
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted by clear(), at the end of the program at the latest."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def clear() -> int:
    """Deletes the tables that were written to shared folders, of which DataFrames made so far may still need some; how many there were."""
    n = len(_made)
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:  # not stopped
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return n


@atexit.register
def _end() -> None:
    clear()
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)


def saved(df: DataFrame, name: str = "cut") -> str:
    """Write ``df`` to a new folder of the shared folder; its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a short lineage that outlives executors."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, name))


def stored(folder: str, columns: list[str], rows: int = 131_072) -> Iterator:
    """In a worker: record batches of at most so many rows of a table in the shared folder, one after the other."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    scheme, _, rest = folder.partition("://")
    if scheme == "file" or not rest:
        files, path = fs.LocalFileSystem(), rest or folder
    else:
        files, path = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)
    yield from ds.dataset(path, format="parquet", filesystem=files).to_batches(columns=columns, batch_size=rows, use_threads=False, batch_readahead=0, fragment_readahead=1)


def read_packed(folder: str, columns: list[str]) -> list[dict[str, bytes]]:
    """In a worker: rows of binary columns of a table in the shared folder."""
    return [row for batch in stored(folder, columns) for row in batch.to_pylist()]
