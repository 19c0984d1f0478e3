import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    s = local_session(4, "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    # small inputs would otherwise come in one partition, and nothing would cross a partition's edge
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
