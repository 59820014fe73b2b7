import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracewell.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        "local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=str(base / "checkpoints"),
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
