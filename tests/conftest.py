import os
import sys

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("roadlake-tests", os.environ.get("TEST_CPUS", "8"), 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
