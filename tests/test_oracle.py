"""Every query with an oracle gives the same rows in both engines, on the smallest tables."""

import os

import pytest

from lamina.plans import registry

from oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_equal_oracle(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    compare(spark, registry.QUERIES[name], registry.SQL[name], FOLDER)
