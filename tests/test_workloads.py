import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from check_oracle import compare, connect
from workloads import REGISTRY

FOLDER = "/root/testdata/sf0.001"
QUICK = [FLAGSHIP, "M10_fuzzy_jaro_winkler", "T14_entity_id", "J4_outer_merge", "R11_edit_batch"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_every_query_has_its_sql():
    assert set(oracle_sql()) <= set(queries())
    assert {name for name in REGISTRY if name not in oracle_sql()} == set()


def test_entry(spark):
    assert entry(spark).count() == 1500


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name).startswith("ok")
