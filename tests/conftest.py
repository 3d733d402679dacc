import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    s = local_session(8, app="ledgerlens-tests", checkpoint_dir=tempfile.mkdtemp(prefix="ledgerlens-tests-"),
                      extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()
