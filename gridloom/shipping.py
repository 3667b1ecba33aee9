"""Sending this package to the executors, so that operators run there without an installation."""

from __future__ import annotations

import atexit
import io
import pathlib
import zipfile

from pyspark.sql import SparkSession

from gridloom.storage import remove, shared_dir, write_bytes

_shipped: set[str] = set()


def package_zip() -> bytes:
    """The sources of this package as a zip that Python imports from."""
    root = pathlib.Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return data.getvalue()


def ship(spark: SparkSession) -> None:
    """Put the package on the path of all Python workers of a session, once.

    Every operator with a function over Arrow batches calls this; the zip lies in the shared folder until the program ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        # Beside the session's tables, not among them: an executor that joins late fetches it too.
        path = f"{shared_dir(spark)}/gridloom-{app}-package.zip"
        write_bytes(spark, path, package_zip())
        atexit.register(remove, spark, path)
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
