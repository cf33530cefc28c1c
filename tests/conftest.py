import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textmill.session import get_session

    s = get_session("local[*]", 8, app_name="textmill-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
