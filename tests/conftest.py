import pytest

from quarry.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", partitions=4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
