"""The parts of summary, interpretation and running figures that older queries leave out."""

import pytest

from pairwright.plans import catalog
from tests.helpers import assert_same


@pytest.mark.parametrize("name", ["a16_pipeline_parts", "a18_schema_error_note", "t2_running_rates"])
def test_parts(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert_same(df, catalog.ORACLES[name], sf)
