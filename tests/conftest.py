import pytest

from veritab.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
