"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every deployment wants; cluster sizing stays with the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "inkstream", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder in the
    warehouse serves, which all executors share too.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()
