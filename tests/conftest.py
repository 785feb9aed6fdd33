import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from daybars.session import checkpoint_dir, get_session
    s = get_session("local[*]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # only creates one when the session has none
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="daybars-test-")


def _key(t):
    return tuple((v is not None, v if v is not None else 0) for v in t)


def rows(df, *cols):
    """Collected rows as tuples, sorted (NULLs first) for order-free compares."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
