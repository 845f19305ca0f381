import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rillstone.session import local_session, ship

    s = local_session(4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
