"""Every registered query of the measurement operators against its SQL."""

import math

import pytest

from fathomix.plans import catalogue
from oracle import DATA, connect, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF if name != "x07_gap_filling" else f"{DATA}/sf0.01")  # few holes in the smallest
    rows = df.limit(200).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
    assert not any(isinstance(v, float) and math.isinf(v) for r in rows for v in r)
