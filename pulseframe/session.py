"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the neighbourhood plans rely on.  The first lets a join on
# (block, cell) reuse a shuffle made on block alone, so the 9- or 27-fold cell
# expansion never crosses the network.  The second keeps grouped collect_list
# hash based for larger batches of keys before it falls back to sorting.
RUNTIME_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# HotSpot leaves methods above 8,000 bytecodes interpreted.  Many descriptors at
# many radii make one long projection, so compile those too.
LAUNCH_CONF = {
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created.

    Estimates of derived tables come from the bytes of compressed files and know nothing of generated rows, so whole tables would
    pass for small: what is broadcast unasked is decided by the bytes that adaptive execution has counted.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    estimated, counted = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(counted, None) is None:
        spark.conf.set(counted, spark.conf.get(estimated))
    spark.conf.set(estimated, "-1")
    return spark


def build_session(app: str = "pulseframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **LAUNCH_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only where nothing is set, and only on one machine (tests), a temporary folder stands in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, for long tables of plain columns: written as Parquet, a fraction of the bytes of a checkpoint.  Rows lose their partitions."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
