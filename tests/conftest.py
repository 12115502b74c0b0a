import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import local_session, ship

    s = local_session(4, "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    return s
