"""Every query against its SQL on the smallest tables, and known counts."""

import oracle
import pytest

import __spark_entry__ as entry
from muster.plans.oracles import oracles
from muster.plans.queries import QUERIES, P

FOLDER = "/root/testdata/sf0.001"
SQL = oracles(P)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


def test_known_counts_at_a_larger_scale(spark):
    folder = "/root/testdata/sf0.01"
    got = {
        (r.layer, r.status): r.n for r in QUERIES["effective_status"](spark, folder).collect()
    }
    assert got == {
        (-1, "ok"): 22645,
        (-1, "not_yet_available"): 3841,
        (0, "ok"): 76371,
        (1, "ok"): 215640,
        (1, "bad_unit"): 9054,
        (1, "not_yet_available"): 17331,
        (2, "bad_type"): 8899,
        (2, "not_yet_available"): 2278,
        (3, "ok"): 24501,
        (3, "bad_unit"): 5377,
        (3, "not_yet_available"): 2964,
        (4, "ok"): 20798,
        (4, "not_yet_available"): 5150,
        (4, "wrong_role"): 6506,
        (4, "uncatalogued"): 13137,
    }
    actions = QUERIES["diff_state"](spark, folder).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in actions} == {
        "create": 30189,
        "noop": 16972,
        "orphan": 4044,
        "update": 7540,
    }
    chosen = QUERIES["select_by_labels"](spark, folder).groupBy("selector_id").count().collect()
    assert {r.selector_id: r["count"] for r in chosen} == {
        "s_empty": 54701,
        "s_in": 15720,
        "s_exists": 12098,
        "s_absent": 42603,
        "s_notin": 42603,
        "s_and": 10378,
    }
    assert QUERIES["propagate_versions"](spark, folder).count() == 6787


def test_entry_runs(spark):
    assert entry.entry(spark).columns == [
        "cluster_id", "role", "role_group", "file", "prop", "value", "layer", "status",
    ]
