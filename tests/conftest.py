import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark
