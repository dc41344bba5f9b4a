"""What driver and executors share: a folder, and the rows of small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, a local session gets a temporary folder of its own; on a cluster
    that would be wrong, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_pagemill_dir", None)
    if found:
        return found.rstrip("/")
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pagemill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context._pagemill_dir = made
    return made


#: Folders that this process has made and not deleted, with what deletes them.
_made: dict[str, tuple] = {}


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; it is deleted by ``release`` or at the end of the process."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def delete(path: str, jvm, conf) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def release(*paths: str) -> None:
    """Delete these work folders, or all of this process. No lazy result that reads one may be used after it.

    It also runs when the process ends: a result may read its folders until then.
    """
    for path in paths or list(_made):
        try:
            delete(path, *_made.pop(path))
        except Exception:  # noqa: BLE001 - at the end of the process the JVM may be gone before
            continue


atexit.register(release)

#: Larger tables are read in as many tasks as they have splits.
SPREAD_BYTES = 1 << 30


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose splits are fewer than the cores, dealt out over all of them; a table of more than a gigabyte stays as it is.

    A file of one row group is one task, however many cores are idle; moving its rows costs less than the work on them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SPREAD_BYTES or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
