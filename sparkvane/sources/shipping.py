"""Making this package importable where Python workers run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

TOP = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to executors, once for each context.

    Only workers of a local master share the driver's folder and Python path;
    there it is not sent if one of these reaches it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sparkvane_shipped", False):
        return
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not local or not any(p and Path(p).resolve() == TOP for p in reachable):
        folder = tempfile.mkdtemp()  # of the driver, which serves it to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        out = Path(folder) / "sparkvane.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted((TOP / "sparkvane").rglob("*.py")):
                z.write(p, p.relative_to(TOP))
        sc.addPyFile(str(out))
    sc._sparkvane_shipped = True
