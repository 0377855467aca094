import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from talus.session import local_session, share_package

    session = local_session(4, 4, "talus-tests", **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield share_package(session)
    session.stop()
