import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.core import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=8, shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    return s
