"""The dealt core operators on empty tables, NULLs, repeated rows, long and blank texts, and clashing columns."""

import pytest

from crease.operators import drift, nested, packed, units

from .conftest import DATA

CASES = {"p1_found": units.p1_found, "p3_found": drift.p3_found, "p3_table": drift.p3_table, "p5_found": packed.p5_found, "p6_found": nested.p6_found}
PLAIN: dict = {}


@pytest.mark.parametrize("name", CASES)
def test_empty_tables_give_no_rows(spark, variant, name):
    assert CASES[name](spark, variant("empty")).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p6_found", "p1_found"])
@pytest.mark.parametrize("how", ["extra", "odd"])
def test_odd_rows_change_nothing_else(spark, variant, name, how):
    if name not in PLAIN:
        PLAIN[name] = {tuple(r) for r in CASES[name](spark, str(DATA)).collect()}
    before = PLAIN[name]
    rows = [tuple(r) for r in CASES[name](spark, variant(how)).collect()]
    assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)
    if how == "extra":
        assert set(rows) == before
    else:
        assert len(before - set(rows)) <= 0.02 * len(before)
