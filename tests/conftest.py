import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session.build(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
