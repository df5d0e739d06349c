import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from quillspan.session import build_session

    session = build_session("tests", 8, "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
