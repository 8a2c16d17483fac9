import pytest

from crawlens import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4, **{"spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
