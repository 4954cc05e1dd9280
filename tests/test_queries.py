import os

import pytest

from koine.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF_DIR, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert not differences(QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])
