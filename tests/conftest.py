import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests"), str(ROOT / "tests" / "llm")]

from logloom.session import local_session, prepare  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
