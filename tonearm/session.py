"""Session settings and the two services every iterative operator needs:
reading a table and cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Settings that hold at any scale; sizes that depend on the cluster are left alone.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "tonearm") -> SparkSession:
    """A session in one process, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: spark.checkpoint.dir, and only where that
    is unset and the session is a single process, a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tonearm-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables written by ``store`` in this process.
_STORED: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the tables that ``store`` wrote; returns how many. Frames that read them must be done with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def store(df: DataFrame) -> DataFrame:
    """Write the rows as a compressed table in the shared checkpoint folder and go on from it.

    For rows that several branches read: columns are pruned and sizes known to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored.hint("merge") if _unpacked(stored) > _broadcast_limit(spark) else stored


#: Bytes of a field of a row that is sent out: of one fixed length, of any other.
FIXED, VARIABLE = 8, 64
#: Bytes of rows that no driver feels.
HARMLESS = 8_000_000


def _unpacked(stored: DataFrame) -> int:
    """Bytes of a stored table once it is read, by its rows (they stand in the files' footers) and fields.

    The planner takes the compressed files for the size, a tenth of it or less, and would send far too much through the driver.
    """
    varies = lambda t: isinstance(t, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
    return stored.count() * (FIXED + sum(VARIABLE if varies(f.dataType) else FIXED for f in stored.schema))


def _broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which a table may be sent out: as the session says, and what is too little to matter in any case."""
    return max(HARMLESS, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
