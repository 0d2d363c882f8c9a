import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "scripts"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from busbar.session import build_session, release

    session = build_session("tests", 8)
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
