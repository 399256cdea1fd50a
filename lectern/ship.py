"""Sending this package to executors, which need it to run its functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors can import this package: sent along where the application hasn't done so yet."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_lectern_sent", False):
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lectern-"), "lectern_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(archive))
        sc._lectern_sent = True
    return df
