"""Written intermediate tables, which cut lineage and outlive a lost executor.

Tables go below the folder that the session names in ``spark.checkpoint.dir``
and are deleted when the session's JVM ends. Only a local session that names none (tests, a laptop) gets
a temporary folder; on a cluster the executors would not share it, so there the name is required.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tabulon-")
    return _FALLBACK[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Parallelism of the reread follows the file sizes, so a small table does not
    come back as thousands of empty tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
