import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tempestry.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    if not Path(SMALL).exists():
        pytest.skip("no test data here")
    return SMALL


@pytest.fixture
def rows():
    """rows(df): sorted tuples."""

    def f(df, *cols):
        return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))

    return f
