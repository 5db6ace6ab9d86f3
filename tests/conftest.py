import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from clickloom.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
