import pytest

from lattice.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
