"""bytelode: analysis of corpora of opaque bytes as Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Give this package to the executors of a session's application, once; needed where it isn't installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="bytelode-")) / "bytelode.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
