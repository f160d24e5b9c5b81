import pytest

from litmill.session import expose_package, make_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = make_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    s.sparkContext.setLogLevel("FATAL")
    expose_package(s)
    yield s
    s.stop()
