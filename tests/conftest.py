"""Shared Spark session for the tests (local mode, small shuffle fan-out).

The tests set their own checkpoint folder (a fresh temporary folder) since
no cluster setting exists here; library code only ever reads the setting.
"""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from driftline.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="driftline-test-ckpt-")
    s = get_spark("local[4]", app="driftline-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt, "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()
