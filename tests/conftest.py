import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from claimspark.schemas import CLAIMS, PATIENTS, PROVIDERS  # noqa: E402
from claimspark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app_name="claimspark-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimspark-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="claimspark-test-")


@pytest.fixture()
def frames(spark):
    def make(claims=(), patients=(), providers=()):
        return (spark.createDataFrame(list(claims), CLAIMS),
                spark.createDataFrame(list(patients), PATIENTS),
                spark.createDataFrame(list(providers), PROVIDERS))
    return make
