import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from siltstone.session import build_session

    return build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
