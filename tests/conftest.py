import pytest

from signalrank.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    spark = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{base}/checkpoints", spark__sql__warehouse__dir=f"{base}/warehouse",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__default__parallelism="4",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
