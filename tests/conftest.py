import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from nearkin.runtime import session

    spark = session("local[8]", 4)
    yield spark
    spark.stop()
