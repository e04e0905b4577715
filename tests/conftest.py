import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    out = session(4)
    out.sparkContext.setLogLevel("ERROR")
    out.conf.set("spark.sql.shuffle.partitions", "4")
    return out
