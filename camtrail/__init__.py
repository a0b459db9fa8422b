"""camtrail: multi-camera video metadata analytics on Spark DataFrames and streams."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def ship(spark, *packages: str) -> None:
    """Send this package (and others beside it) to the executors, once per Spark context.

    Needed where the executors do not have it installed: tasks that score,
    link or embed import it there.
    """
    context = spark.sparkContext
    names = {"camtrail", *packages} - getattr(context, "_camtrail_shipped", set())
    if not names:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-", dir="/tmp")) / f"{'-'.join(sorted(names))}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for name in sorted(names):
            for path in sorted((root / name).rglob("*.py")):
                out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    # The worker that prepares stateful streaming on the driver gets no files, only the environment.
    before = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *([before] if before else [])])
    context._camtrail_shipped = getattr(context, "_camtrail_shipped", set()) | names
