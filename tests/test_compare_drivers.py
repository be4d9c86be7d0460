import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adpulse.operators import drivers
from adpulse.operators.anchors import Anchors
from adpulse.operators.compare import two_day_compare, two_day_sums
from conftest import CFG, D0

D1 = D0 + dt.timedelta(days=1)
A = Anchors(d_max=D1, d_prev=D0, d_min=D0)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_identical_days_give_zero_deltas(sample_fact):
    d = D0 + dt.timedelta(days=4)
    rows = two_day_compare(sample_fact, ["media"], "ss", d, d - dt.timedelta(days=1), CFG).collect()
    assert len(rows) == 3
    assert all(r["rev_delta"] == 0 and r["roas_delta"] == 0 and r["influence"] == 0 for r in rows)
    # Ties on influence end on the key.
    assert [r["media"] for r in rows] == sorted(r["media"] for r in rows)


def test_one_sided_keys_and_missing_bucket(make_fact):
    """H3 + N4 + N10: keys on one day only get zeros on the other; a null key is
    the missing bucket."""
    f = make_fact([dict(activity_date=D1, media="only_cur", rev_db=10, cost=5, buy_db=1),
                   dict(activity_date=D0, media="only_prev", rev_db=4, cost=2, buy_db=2),
                   dict(activity_date=D1, media=None, rev_db=1, cost=0)])
    r = by(two_day_compare(f, ["media"], "db", D1, D0, CFG), "media")
    assert r["only_cur"]["rev_prev"] == 0.0 and r["only_cur"]["rev_delta"] == 10.0
    assert r["only_cur"]["roas_cur"] == 200.0 and r["only_cur"]["roas_prev"] == 0.0
    assert r["only_prev"]["rev_cur"] == 0.0 and r["only_prev"]["buy_delta"] == -2
    assert r[CFG.missing]["roas_cur"] == 0.0  # cost 0 → ROAS 0
    assert list(r)[0] == "only_cur"  # largest |change| first


def test_single_date_compare(make_fact):
    """H5: previous day = last day → every delta is 0."""
    f = make_fact([dict(activity_date=D0, rev_ss=5, cost=1)])
    r = two_day_compare(f, ["media"], "ss", D0, D0, CFG).collect()[0]
    assert r["rev_cur"] == r["rev_prev"] == 5.0 and r["rev_delta"] == 0.0


rows_strategy = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.booleans(),
                                   st.integers(0, 1000), st.integers(0, 50)), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_conditional_aggregation_equals_full_outer_join(make_fact, rows):
    """Property: one-scan conditional aggregation == per-day group-by + full
    outer join + fillna(0); swapping the days negates the deltas."""
    f = make_fact([dict(activity_date=D1 if cur else D0, media=m, rev_ss=r, cost=c)
                   for m, cur, r, c in rows])
    got = by(two_day_compare(f, ["media"], "ss", D1, D0, CFG), "media")
    keyed = f.withColumn("media", F.coalesce("media", F.lit(CFG.missing)))
    a = keyed.where(F.col("activity_date") == D1).groupBy("media").agg(F.sum("rev_ss").alias("x"))
    b = keyed.where(F.col("activity_date") == D0).groupBy("media").agg(F.sum("rev_ss").alias("y"))
    j = a.join(b, "media", "full_outer").na.fill(0)
    want = {r["media"]: float(r["x"]) - float(r["y"]) for r in j.collect()}
    assert {k: v["rev_delta"] for k, v in got.items()} == want
    swapped = by(two_day_compare(f, ["media"], "ss", D0, D1, CFG), "media")
    assert all(swapped[k]["rev_delta"] == -got[k]["rev_delta"] for k in got)


def drill_fact(make_fact):
    return make_fact([
        dict(activity_date=D1, channel="StoreA", media="Search", product="p1", rev_ss=100, cost=10,
             campaign="c1", ad_group="g1", rev_db=50),
        dict(activity_date=D0, channel="StoreA", media="Search", product="p2", rev_ss=30, cost=10,
             campaign="c2", ad_group=None, rev_db=80),
        dict(activity_date=D1, channel=" StoreA ", media="Display X", product="-", rev_ss=20, cost=1),
        dict(activity_date=D1, channel="Mkt shop", media="Mkt", product="p1", rev_ss=70, cost=7),
        dict(activity_date=D1, channel=None, media="Other", product="p9", rev_ss=999, cost=1),
        dict(activity_date=D1, channel="StoreA", media=None, product="p3", rev_ss=40, cost=4,
             campaign=None, ad_group=None, rev_db=40),
        dict(activity_date=D1, channel="x", media="Banner", rev_db=12, cost=3),
        dict(activity_date=D0, channel="x", media="Promo", rev_db=6, cost=3),
    ])


def test_channel_sections(make_fact):
    f = drill_fact(make_fact)
    head = by(drivers.channel_headline(f, CFG, A), "section")
    # store = trimmed exact name: Search(100-30) + Display X(20) + null media(40); null channel excluded
    assert head["store"]["rev_cur"] == 160.0 and head["store"]["rev_prev"] == 30.0
    assert head["market"]["rev_cur"] == 70.0
    top = drivers.channel_drivers(f, CFG, A, k=3).collect()
    store = [r["media"] for r in top if r["section"] == "store"]
    assert store == ["Search", CFG.missing, "Display X"]


def test_product_drill_includes_missing_bucket_and_skips_market(make_fact):
    f = drill_fact(make_fact)
    rows = drivers.media_product_drivers(f, CFG, A).collect()
    got = {(r["media"], r["product"]) for r in rows}
    assert ("Search", "p1") in got and ("Search", "p2") in got
    assert (CFG.missing, "p3") in got  # N9: the missing bucket drills properly
    assert not any(m == "Mkt" for m, _ in got)  # market media skipped
    assert not any(p == "-" for _, p in got)  # invalid labels removed


def test_campaign_drivers_labels_and_summary(make_fact):
    f = drill_fact(make_fact)
    camp = by(drivers.media_campaign_drivers(f, CFG, A), "media", "campaign")
    assert camp[("Search", "c2")]["label"] == "c2"  # missing group dropped from the path
    assert camp[(CFG.missing, CFG.missing)]["label"] == CFG.path_fallback_driver
    summ = by(drivers.media_summary(f, CFG, A), "media")
    assert summ["Search"]["key_campaign"] == "c2"  # |−80| beats |+50|
    assert summ[CFG.missing]["key_campaign"] == "-"


def test_display_breakdown_and_tree(make_fact):
    f = drill_fact(make_fact)
    disp = by(drivers.display_media_breakdown(f, CFG, A), "media")
    assert set(disp) == {"Banner", "Promo"} and disp["Promo"]["rev_delta"] == -6.0
    tree = drivers.drilldown_tree(f, CFG, A).collect()
    levels = {r["level"] for r in tree}
    assert levels == {"media", "product", "campaign", "display_sub_media"}
    assert {r["parent"] for r in tree if r["level"] == "display_sub_media"} == {"Display X"}


def test_per_media_change_tables(make_fact):
    f = drill_fact(make_fact)
    ch = drivers.campaign_change_top(f, CFG, A, k=1).collect()
    assert {r["media"] for r in ch} == {"Search", "Display X", "Mkt", "Other", "Banner", "Promo"}
    assert all(r["rank"] == 1 for r in ch)


def test_two_day_sums_unfilled_keys(make_fact):
    f = make_fact([dict(activity_date=D1, media=None, rev_ss=1)])
    r = two_day_sums(f, ["media"], "ss", D1, D0, CFG, fill_keys=False).collect()
    assert r[0]["media"] is None


def test_source_without_channel_column(spark):
    """with no channel column in the source, the store section is the
    whole fact, the market section is empty and the product pages apply no
    channel filter."""
    from adpulse.operators.ranking import product_rows
    from adpulse.sources.schema import column_absent, conform
    raw = spark.createDataFrame(
        [(str(D1), "Search", "p1", 10.0, 50.0, 40.0), (str(D0), "Search", "p1", 5.0, 20.0, 10.0)],
        ["날짜", "매체상세", "실 전환 발생 상품", "비용(markup+)",
         "(스마트스토어센터기준) 전체 매출", "(대시보드기준) 전체 매출"])
    f = conform(raw)
    assert column_absent(f, "channel") and not column_absent(f, "media")
    head = by(drivers.channel_headline(f, CFG, A), "section")
    assert set(head) == {"store"} and head["store"]["rev_delta"] == 30.0
    assert product_rows(f, CFG).count() == 2
