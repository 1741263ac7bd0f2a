import pytest

from sheafline.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("sheafline-tests", 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s


SF = "/root/testdata/sf0.001"
