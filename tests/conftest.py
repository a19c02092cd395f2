import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from condensa.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="condensa-tests")
    yield s


def one(spark, expr_sql, **cols):
    """Evaluate one SQL expression over a one-row DataFrame of string columns."""
    from pyspark.sql import functions as F
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(F.expr(expr_sql).alias("v")).first()["v"]
