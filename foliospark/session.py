"""Session settings and table loading shared by the library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results rely on (time zone) or that plans profit from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "*", app: str = "foliospark", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster, pass your own session to every function instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_foliospark_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="foliospark-code-")) / "foliospark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._foliospark_shipped = True
