import os

import pytest

from rudderql.llm import queries as Q

from ..compare import connect, differences

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(name, spark):
    assert differences(spark, connect(SF), SF, Q.queries()[name], Q.oracle_sql()[name]) is None
