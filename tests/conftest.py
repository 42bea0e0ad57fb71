import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerline.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="ledgerline-tests")


@pytest.fixture(scope="session")
def data(spark):
    from ledgerline.plans.store import data_set

    return data_set(spark, TESTDATA)
