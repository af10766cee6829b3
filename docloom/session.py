"""Session helpers: a local test session, shipping of this package to executors, and checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int = 8, app: str = "docloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # The driver only serves this file; executors fetch it through Spark.
    target = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir`` as the session has it. Only where that is unset, as in
    tests, a folder of this machine is set, which suits a local master alone.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` gave and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(path.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
