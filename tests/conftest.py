import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillgraph.session import build_session, ship

    folder = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", 4, **{"spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
