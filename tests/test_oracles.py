"""Every registered query with SQL against that SQL on the smallest tables; the queries run a few at a time."""

import math
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry_points
from knotwork.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracles())


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def found(spark, request):
    wanted = {item.callspec.params["name"] for item in request.session.items if getattr(item, "callspec", None) and "name" in item.callspec.params}

    def run(name):
        frame = catalog.queries()[name](spark, FOLDER)
        return frame.columns, frame.collect()

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in NAMES if name in wanted}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(found, duck, name):
    columns, rows = found[name].result()
    columns = sorted(columns)
    result = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    wanted = sorted(tuple(cell(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(cell(row[c]) for c in columns) for row in rows) == wanted


def test_entry_and_registry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
