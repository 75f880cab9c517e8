import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("WEAKLOOM_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from weakloom.session import build_session
    session = build_session("weakloom-tests", "local[4]", spark__sql__shuffle__partitions="4",
                            spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.001")
