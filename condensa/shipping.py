"""Ship this package to the executors' Python workers (like ``--py-files``).

Only the Arrow-batched helpers (JSON with repeated keys, streaming state, some training-data operators) run
Python on executors; they import ``condensa``. The package is zipped once per SparkContext and
added with ``addPyFile``, which distributes it to every executor.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set = set()


def ship(spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="condensa-pyfiles-"), "condensa.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("condensa", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
