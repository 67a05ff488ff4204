"""The registered training-data queries with SQL, compared with it on the small tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

import check_oracles  # noqa: E402
from cohortlens.llm.queries import SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    outcome = check_oracles.compare(spark, con, name, SF)
    assert outcome.startswith("ok"), outcome
