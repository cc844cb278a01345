import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventspark.session import build_session  # noqa: E402

DATA = os.environ.get("EVENTSPARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__driver__bindAddress="127.0.0.1", spark__driver__host="127.0.0.1",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="eventspark-test-ckpt-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"


@pytest.fixture
def cut(spark):
    """Make every key of more than a few rows a hot one."""
    from eventspark.operators.ordered import BLOCKS_CONF, LIMIT_CONF

    spark.conf.set(LIMIT_CONF, "7")
    spark.conf.set(BLOCKS_CONF, "1000000")
    yield
    spark.conf.unset(LIMIT_CONF)
    spark.conf.unset(BLOCKS_CONF)
