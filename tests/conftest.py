import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nitlake import session  # noqa: E402
from nitlake.session import ship  # noqa: E402
from nitlake.sinks.png import encode_png  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()


@pytest.fixture
def put():
    """Write a picture of integer codes (3, h, w)."""

    def write(path, picture, depth=16):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(encode_png(np.asarray(picture), depth))

    return write
