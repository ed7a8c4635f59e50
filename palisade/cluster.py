"""What jobs need of the cluster: the package on the executors, tables dealt to the cores, staging in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="spark-")).resolve() / "palisade_package.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(file))
        _sent.add(context.applicationId)
    return spark


def compiled(spark: SparkSession) -> SparkSession:
    """HotSpot never compiles a method of more than 8,000 bytes: expressions that would fill one are cut into several (unless the session says otherwise)."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default
        spark.conf.set(key, "8000")
    return spark


#: Tables up to this size are dealt to the cores; beyond it they stay as they are read.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer splits than cores is dealt to all cores (16 KB each at least); by its size in the plan."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(max(1, min(cores, size >> 14))) if size <= SMALL_BYTES and splits < cores else df


def plan_bytes(df: DataFrame) -> int:
    """The size of what a plan reads, as it estimates it (what it makes of joins would be their product); unknown sizes count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 50)


def dealt(df: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """A table that costs much for its bytes (texts under many patterns), in tasks of about ``task_bytes``."""
    tasks = plan_bytes(df) // task_bytes
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def is_local(spark: SparkSession) -> bool:
    """One JVM: no executor elsewhere that would miss the driver's files."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder, which is
    then set for the session; a cluster must name one.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder (with ``by``, a folder for each value) and read it back.

    This cuts the lineage: what is read later survives lost executors and is
    never computed twice.
    """
    path = f"{shared_folder(df.sparkSession)}/palisade-{uuid.uuid4().hex}/{label}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(re.sub(r"(/palisade-[0-9a-f]{32})/.*", r"\1", name))
        path.getFileSystem(conf).delete(path, True)
