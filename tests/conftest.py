import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from allelith.session import session

    s = session("tests", cores=4, shuffle_partitions=4, **{"spark.sql.autoBroadcastJoinThreshold": "256k"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
