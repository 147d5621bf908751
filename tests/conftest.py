import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadweave.session import builder, local_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield local_scratch(session)


def values(df, *columns):
    one = len(columns) == 1 and columns[0] != "*"
    return [r[0] if one else tuple(r) for r in df.select(*columns).collect()]
