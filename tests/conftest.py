import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from sward.session import local_session  # noqa: E402

SF_DIR = os.environ.get("SWARD_TEST_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=4, app="sward-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from sward.plans import shared

    shared.release(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables at {SF_DIR}")
    return SF_DIR


@pytest.fixture()
def rows(spark):
    """Build a small frame from a DDL and rows."""
    return lambda ddl, data: spark.createDataFrame(data, ddl)


def as_dict(df, keys, value):
    keys = [keys] if isinstance(keys, str) else keys
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        assert k not in out, f"duplicate key {k}"
        out[k if len(keys) > 1 else k[0]] = r[value]
    return out
