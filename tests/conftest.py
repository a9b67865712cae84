import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.session import build_session, checkpoint_root, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    session = build_session("marginalia-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_root(session)
    ship_package(session)
    yield session
    session.stop()
