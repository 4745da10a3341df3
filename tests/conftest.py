import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from moderato.session import local_session
    s = local_session("*", shuffle_partitions=8, app="moderato-tests")
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
