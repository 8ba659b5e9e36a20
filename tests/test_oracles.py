"""Every registered query of the library against its SQL on the small tables."""

import pytest

from conftest import same_rows
from stumpwright.plans.all_queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        same_rows(df, duck, ORACLE[name])
    else:
        assert df.count() > 0
