import pytest

from snapstats.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
