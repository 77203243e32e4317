import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quasirisk import build_session

    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def loans(spark):
    """Readers of a library; expected values in the tests follow from the definitions by hand."""
    return spark.createDataFrame(
        [
            (0, 120, "Harbour", "maps", 14),
            (1, 80, "Hill", "plays", 22),
            (2, 120, "Harbour", "plays", 14),
            (3, 95, "Mill", "maps", 31),
            (4, 80, "Hill", "plays", 22),
            (5, 95, "Harbour", "maps", 31),
        ],
        "id long, fee long, branch string, genre string, visits long",
    )
