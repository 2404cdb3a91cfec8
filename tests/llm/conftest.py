import pytest

from pulse.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)
