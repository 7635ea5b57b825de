import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparkgrove.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 2)
    session.sparkContext.setLogLevel("ERROR")
    # the tables are tiny: compiling whole stages would take longer than running them
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("the test tables are not here")
    return DATA
