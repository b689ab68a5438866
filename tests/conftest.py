import pytest

from assayframe.sources.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))
    yield s
    s.stop()
