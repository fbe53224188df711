import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from compare import SF_SMALL

    from ledgerloom.sources.sample import SampleLedger

    return SampleLedger(spark, SF_SMALL)
