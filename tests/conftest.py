import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from seedweave.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()
