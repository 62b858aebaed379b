import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from churnwise.session import build_session
    s = build_session("local[4]", app="churnwise-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():          # tests own an unset checkpoint folder
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()
