"""Session settings and the one place where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle: a hot key in one
    # task costs more than moving its rows again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Files are compressed; judge whether a side fits a broadcast by its decoded size.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # The JVM compiles no method above 8,000 bytes; a stage with a larger one (a fact's flags and keys) would be
    # interpreted, so it is generated operator by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Tables a run writes for itself or publishes; about two thirds of the default codec's size.
CODEC = "zstd"


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive switches the joins count on; leaves sizing to the cluster."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "canvass", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with the adaptive switches on; dots in ``conf`` are written ``__``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    # Recording the Python call site of every column costs more than building the plan.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="canvass-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/canvass-{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the plan that made it, so a lost executor cannot
    make two readers of it disagree, and each reader scans only the columns it needs.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the one table that ``write_once`` returned as ``df``, once nothing reads it any more."""
    held = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in held]:
        _written.remove(path)
        _delete(df.sparkSession, path)


def discard_written(spark: SparkSession) -> int:
    """Delete what ``write_once`` wrote in this program, once no result needs it any more."""
    gone = 0
    while _written:
        gone += _delete(spark, _written.pop())
    return gone


def shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 512 << 20) -> int:
    """A value for ``spark.sql.shuffle.partitions``: about ``target_bytes`` per task, and a
    multiple of the cores, so the last wave is full. The adaptive planner merges small ones.
    """
    waves = -(-input_bytes // (target_bytes * cores))
    return max(1, waves) * cores
