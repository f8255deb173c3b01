"""What the library needs of a session."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application.

    Functions that run on executors import it; on a cluster the driver's folders are not
    theirs, so it goes along as a zip file.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        file = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern_package.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        context.addPyFile(str(file))
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this one machine a temporary folder is taken;
    elsewhere executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="lectern-shared-")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
