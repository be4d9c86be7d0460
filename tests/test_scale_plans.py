"""Plan-shape guards for scale: what each registered query must and must not
contain, and exactness on a skewed fixture."""

import datetime as dt
import os
import re
from collections import defaultdict
from decimal import Decimal

import pytest

from adpulse.operators.compare import two_day_compare
from adpulse.operators.ranking import top_k_per_group
from adpulse.plans.registry import QUERIES
from conftest import CFG, D0

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_no_cartesian_nested_loop_or_python_in_any_query(spark):
    bad = {}
    for name, fn in QUERIES.items():
        plan = executed_plan(fn(spark, SF))
        hits = [p for p in FORBIDDEN if p in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_partial_aggregation_before_every_shuffle(spark, make_fact):
    """A hot key collapses to one row per task before the exchange."""
    f = make_fact([dict(activity_date=D0, media="hot", rev_ss=1)] * 50)
    plan = two_day_compare(f, ["media"], "ss", D0, D0, CFG, order=False) \
        ._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    exch = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exch, plan
    below = "\n".join(lines[exch[0]:])
    assert "partial_sum" in below


def test_grouped_top_k_limits_before_the_shuffle(spark, make_fact):
    f = make_fact([dict(media=m, keyword=str(i), rev_ss=i) for m in "ab" for i in range(30)])
    from pyspark.sql import functions as F
    g = f.groupBy("media", "keyword").agg(F.sum("rev_ss").alias("rev_ss"))
    for order in ([F.col("rev_ss").desc(), F.col("keyword")], ["rev_ss DESC", "keyword ASC"]):
        q = top_k_per_group(g, ["media"], order, 3)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"WindowGroupLimit .* Partial", plan), plan
        assert sorted((r["media"], r["rank"], r["keyword"]) for r in q.collect()) == [
            ("a", 1, "29"), ("a", 2, "28"), ("a", 3, "27"),
            ("b", 1, "29"), ("b", 2, "28"), ("b", 3, "27")]


def test_skewed_key_results_equal_brute_force(make_fact):
    """One media holds a third of the rows; results equal a plain Python
    computation of the same comparison."""
    d1 = D0 + dt.timedelta(days=1)
    rows = []
    for i in range(600):
        media = "hot" if i % 3 == 0 else f"m{i % 17}"
        day = d1 if i % 2 else D0
        rows.append(dict(activity_date=day, media=media, rev_ss=i % 97, cost=i % 13, buy_ss=i % 5))
    f = make_fact(rows)
    got = {r["media"]: (r["rev_delta"], r["cost_cur"], r["buy_delta"])
           for r in two_day_compare(f, ["media"], "ss", d1, D0, CFG).collect()}
    acc = defaultdict(lambda: [Decimal(0)] * 5)
    for r in rows:
        a = acc[r["media"]]
        if r["activity_date"] == d1:
            a[0] += Decimal(r["rev_ss"])
            a[2] += Decimal(r["cost"])
            a[3] += r["buy_ss"]
        else:
            a[1] += Decimal(r["rev_ss"])
            a[4] += r["buy_ss"]
    want = {m: (float(a[0] - a[1]), float(a[2]), int(a[3] - a[4])) for m, a in acc.items()}
    assert got == want


def test_choice_lists_unfold_distinct_keys_only(make_fact):
    """the generator stands above an aggregate, so the history's rows are
    not multiplied."""
    from adpulse.operators import dimensions
    f = make_fact([dict(media="a", campaign="c", brand="b", ad_group=str(i % 2)) for i in range(9)])
    q = dimensions.dimension_values(f)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate inline.*\n\s+\+- Aggregate", plan), plan
    assert [(r["dimension"], r["value"]) for r in q.collect()] == [
        ("ad_group", "0"), ("ad_group", "1"), ("brand", "b"), ("campaign", "c"), ("media", "a")]


def test_drill_down_leaves_the_callers_lists_to_spark(make_fact):
    """No forced broadcast of a frame that the caller passes."""
    from adpulse.operators import drivers
    f = make_fact([dict(activity_date=D0, media=m, rev_db=1) for m in "abc"])
    q = drivers.media_campaign_drivers(f, CFG, only_media=f.select("media"))
    assert "strategy=broadcast" not in q._jdf.queryExecution().analyzed().toString()


@needs_data
def test_no_query_starts_a_job_before_it_is_run(spark):
    """the anchors come from the list of days, so building a query reads no fact.
    (Three read driver tables beside it, whose schemas are looked up.)"""
    QUERIES["mtd_totals"](spark, SF)  # the snapshot is written once
    context = spark.sparkContext
    jobs = {}
    for name, fn in QUERIES.items():
        context.setJobGroup(f"built-{name}", name)
        fn(spark, SF)
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(f"built-{name}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {k for k, n in jobs.items() if n} <= {"period_table", "snapshot_parity", "snapshot_parity_totals"}


def test_a_table_of_periods_is_one_scan(spark, make_fact):
    """1,000 overlapping periods equal a sum over their days."""
    from adpulse.operators.periods import period_table
    days = [D0 + dt.timedelta(days=i) for i in range(40) if i % 7]
    fact = make_fact([dict(activity_date=d, cost=i + 1, clicks=i, brand="ab"[i % 2]) for i, d in enumerate(days * 3)]
                     + [dict(activity_date=None, cost=99)])
    made = [(i, D0 + dt.timedelta(days=i % 61 - 10), D0 + dt.timedelta(days=i % 61 - 10 + i % 23 - 2)) for i in range(1000)]
    made += [(1000, None, D0), (1001, D0, None), (1002, D0, D0), (1002, D0, D0)]
    table = spark.createDataFrame(made, "id int, period_start date, period_end date")
    for brand in (None, "a"):
        q = period_table(fact, table, brand=brand)
        got = sorted((r["id"], r["cost"], r["clicks"]) for r in q.collect())
        cells = [(r["activity_date"], float(r["cost"]), r["clicks"]) for r in fact.collect()
                 if r["activity_date"] and brand in (None, r["brand"])]
        want = []
        for i, s, e in made:
            own = [c for c in cells if s and e and s <= c[0] <= e]
            want.append((i, sum(c[1] for c in own), sum(c[2] for c in own)))
        assert got == sorted(want)
    plan = period_table(fact, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
