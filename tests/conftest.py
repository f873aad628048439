import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from custaris.session import local_session
    s = local_session("4", app="custaris-tests", extra={
        "spark.sql.shuffle.partitions": "8",
        "custaris.model.tune": "false",  # the tuned chain has a test of its own, with short grids
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="custaris-test-ckpt-")})
    yield s
    s.stop()
