"""Star storage layouts: day-partitioned fact gives the same answers and prunes directories."""

from __future__ import annotations

import contextlib
import io
import re
import tempfile

from shelfwise import ANALYSES, derive_star, read_star, write_star
from tests.conftest import TESTDATA


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _nodes(plan):
    """All operators of a plan that ran, inside of adaptive stages too."""
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        out.append(node)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out


def test_day_partitioned_fact_matches_and_prunes(spark):
    star = derive_star(spark, f"{TESTDATA}/sf0.001")
    flat = write_star(star, tempfile.mkdtemp(prefix="flat-", dir="/tmp"))
    by_day = write_star(star, tempfile.mkdtemp(prefix="byday-", dir="/tmp"), partition_by="Date_SK")
    assert by_day.fact.schema == flat.fact.schema
    for key in ("q07_reorder_point", "q25_action_plan", "q03_latest_stock_by_location"):
        a = sorted(tuple(r) for r in ANALYSES[key](flat).collect())
        b = sorted(tuple(r) for r in ANALYSES[key](by_day).collect())
        assert a == b, key
    text = _plan(ANALYSES["q07_reorder_point"](by_day))
    assert "PartitionFilters: [isnotnull(Date_SK" in text and "(Date_SK#" in text
    # A deferred star: the bound is a subquery on the calendar, and directories are left out when the query runs.
    text = _plan(ANALYSES["q07_reorder_point"](by_day.deferred()))
    assert re.search(r"PartitionFilters: \[isnotnull\(Date_SK[^\]]*Date_SK#\d+ >= Subquery", text)
    for star in (by_day, by_day.deferred()):
        run = ANALYSES["q01_stock_status_current"](star)
        run.collect()
        nodes = _nodes(run._jdf.queryExecution().executedPlan())
        scans = [p for p in nodes if "Inventory_Level" in p.toString() and "Scan" in p.nodeName()]
        assert scans and scans[0].metrics().apply("numPartitions").value() == 1


def test_read_star_round_trip(spark):
    star = derive_star(spark, f"{TESTDATA}/sf0.001")
    path = tempfile.mkdtemp(prefix="star-", dir="/tmp")
    written = write_star(star, path)
    again = read_star(spark, path)
    assert again.fact.count() == written.fact.count() == star.fact.count()
    assert again.date.count() == star.date.count()
