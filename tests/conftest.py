import pytest

from changemap.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests", "local[8]", spark__sql__maxMetadataStringLength="4000",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
