import pytest

from quarry.plans import catalog
from tests.compare import same


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, name):
    frame = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        assert same(frame, catalog.ORACLES[name], sf) > 0
    else:
        assert frame.count() > 0
