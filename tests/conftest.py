import pytest


@pytest.fixture(scope="session")
def spark():
    from rangeforge.session import local_session

    session = local_session("tests", cpus=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
