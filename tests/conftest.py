import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from versio.session import local_session

    s = local_session(shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    import uuid

    from versio.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"
