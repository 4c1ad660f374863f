import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", shuffle_partitions="4", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def dec(text):
    return None if text is None else Decimal(text)
