import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from weirlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(
        "8",
        4,
        **{
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="weirlog-tests-"),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="weirlog-test-")
