"""Session settings on which the engine's results depend."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (local tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = f"{tempfile.gettempdir()}/lakeloom-shared"
    return found.rstrip("/")
