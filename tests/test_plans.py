"""Plan properties that the design relies on at scale, checked on the executed plans."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as E
from rageval.operators import lexical
from rageval.plans.fixtures import fixtures
from rageval.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def explain(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plan(df) -> str:
    """The final adaptive plan tree (without the initial plan and node details)."""
    return explain(df).split("+- == Initial Plan ==")[0]


def test_no_query_plans_a_cross_product(spark):
    bad = {}
    for key, fn in E.queries().items():
        text = plan(fn(spark, SF))
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in text]
        if hits:
            bad[key] = hits
    assert bad == {}


def test_bm25_scores_bucketed_postings_without_a_shuffle(spark):
    fx = fixtures(spark, SF)
    full = explain(lexical.bm25_search(fx.ws_index, fx.queries, 3, small=fx.small))
    assert "Bucketed: true" in full and "SortMergeJoin" not in full
    # the postings scan feeds the join and the per-(query, doc) aggregate directly:
    # the first exchange above the scan comes after the partial top-k
    lines = full.split("+- == Initial Plan ==")[0].splitlines()
    assert any("BroadcastHashJoin" in ln for ln in lines)
    scan = next(i for i, ln in enumerate(lines) if "rageval_postings_ws" in ln)
    above = lines[:scan]
    last_exchange = max(i for i, ln in enumerate(above) if "Exchange" in ln)
    between = above[last_exchange:scan]
    assert any("WindowGroupLimit" in ln for ln in between)
    assert any("HashAggregate" in ln for ln in between)


def test_dedupe_aggregates_before_the_shuffle(spark):
    df = tables.corpus(spark, SF)
    tree = plan(df).splitlines()
    ex = max(i for i, ln in enumerate(tree) if "Exchange" in ln)
    assert any("Aggregate" in ln for ln in tree[ex + 1:])
