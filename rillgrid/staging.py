"""Tables written to the shared folder of the cluster.

Iterative operators and score chains that need one frame several times write it once as
Parquet and read it back: lineage ends there, readers prune columns, and the loss of an
executor costs no recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which a cluster has to set.

    A local master without the setting, as in a notebook, gets a folder of its own that goes with the process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], True)
    return _own[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete settled tables of finished rounds."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = shared_dir(spark)
    for frame in frames:
        folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        for folder in folders:
            if "/rillgrid/" in folder and root.split(":", 1)[-1].lstrip("/") in folder:
                path = hadoop.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_all(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder; for when its queries are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rillgrid/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession) -> int:
    """How many tables of this application lie in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rillgrid/{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(files.listStatus(path)) if files.exists(path) else 0
