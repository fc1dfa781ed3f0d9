"""Sessions, tables and staged results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession


def local_session(name: str = "tesserae", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, in a local session only, one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "tesserae-scratch")
    return shared.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session may have ended first


_scopes = threading.local()  # a thread's stagings hold what it stages itself


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is removed at the end of the `staging` around, or else of the program."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    else:
        atexit.register(_drop, spark, path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside when it is done: for long-running programs."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            _drop(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_within(df: DataFrame, seconds: float) -> list[Row] | None:
    """The rows of df, or None if they take longer; its jobs are cancelled then."""
    context, tag = df.sparkSession.sparkContext, f"within-{uuid.uuid4().hex}"
    out: dict[str, object] = {}

    def run() -> None:
        context.addJobTag(tag)
        try:
            out["rows"] = df.collect()
        except Exception as e:  # cancelled, or failed
            out["error"] = e
        finally:
            context.removeJobTag(tag)

    t = InheritableThread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        context.cancelJobsWithTag(tag)
        return None
    if "error" in out:
        raise out["error"]
    return out["rows"]


class Latest:
    """Of several questions asked one after the other only the last is answered: a newer one cancels the jobs of those
    before, which come back as None."""

    def __init__(self, spark: SparkSession) -> None:
        self.context, self.generation, self._lock = spark.sparkContext, 0, threading.Lock()
        self._name = uuid.uuid4().hex

    def ask(self, make: Callable[[], DataFrame]) -> list[Row] | None:
        with self._lock:
            self.generation += 1
            mine = self.generation
        self.context.cancelJobsWithTag(f"{self._name}-{mine - 1}")
        tag = f"{self._name}-{mine}"
        self.context.addJobTag(tag)
        try:
            rows = make().collect()
        except Exception:
            if mine == self.generation:
                raise
            return None
        finally:
            self.context.removeJobTag(tag)
        return rows if mine == self.generation else None


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is a plain scan of so few partitions that half of the cores or more would idle.

    Small or badly split files only: a table of more partitions is left where it is, and a plan with shuffles of its
    own isn't looked at (that would run them)."""
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, unless PYTHONPATH already does."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="tesserae-")) / "tesserae.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "tesserae").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, True)
