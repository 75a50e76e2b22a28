import pytest

from msgpipe.session import builder, configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("msgpipe-tests").master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
