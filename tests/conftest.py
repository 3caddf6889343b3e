import os

os.environ.setdefault("OMP_NUM_THREADS", "1")
import pytest

from pagelattice.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "3g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
