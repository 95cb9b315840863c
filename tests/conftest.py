import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from trailmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=4, memory="6g", scratch=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Treat every group of more than 20 rows as hot, so that lanes are cut."""
    spark.conf.set("spark.trailmark.hotGroupRows", "20")
    yield spark
    spark.conf.unset("spark.trailmark.hotGroupRows")
