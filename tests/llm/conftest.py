import pytest


@pytest.fixture(scope="session")
def sf_small():
    """The smallest of the given data sets."""
    return "/root/testdata/sf0.001"
