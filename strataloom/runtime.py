"""What the package needs of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each context, wherever they run."""
    ctx = spark.sparkContext
    if getattr(ctx, "_strataloom", None) is None:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="strataloom-")) / "strataloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        ctx.addPyFile(str(target))
        ctx._strataloom = str(target)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a new local one where it is unset and all runs on
    one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
