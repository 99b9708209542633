import pytest

from citeloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__ansi__enabled="true"
    )
