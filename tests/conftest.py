import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    s = session()
    yield s
    s.stop()


@pytest.fixture
def small_blocks(spark):
    """Seven rows per block: every operator has to cross block borders."""
    spark.conf.set("kinetrail.blockRows", "7")
    yield spark
    spark.conf.unset("kinetrail.blockRows")
