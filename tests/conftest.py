import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import session

    spark = session(4)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def con():
    from compare import database

    return database(DATA)
