import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wirefold.session import build_session
    s = build_session(cpus="*", shuffle_partitions=8, app_name="wirefold-tests")
    yield s
    s.stop()
