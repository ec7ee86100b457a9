"""Every query of the library against its SQL on the smallest tables; those without SQL must run."""

import pytest

from pairwright.plans import catalog
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        assert_same(df, catalog.ORACLES[name], sf)
    else:
        assert df.count() > 0
