import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from terrane.session import local_session

    session = local_session(4, "tests", **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF
