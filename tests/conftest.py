from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adpulse.config import FigureConfig  # noqa: E402
from adpulse.session import build_session  # noqa: E402
from adpulse.sources.schema import FACT_SCHEMA  # noqa: E402

D0 = dt.date(2026, 4, 1)

# Labels used by the hand-built frames (same roles as the reference's).
CFG = FigureConfig(
    missing="(none)",
    store_channel="StoreA",
    store_marker="store",
    store_target_aliases=("store",),
    market_marker="Mkt",
    market_target_names=("mkt",),
    market_target_aliases=("coup",),
    other_target="othermall",
    product_excluded_media="Mkt|Gm",
    display_marker="Display",
    display_sub_media=("Banner", "Promo", "Channel"),
    keyword_media=("Search", "Shop Search"),
    creative_media=("Banner", "Promo"),
    always_on_marker="always",
)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="adpulse-tests", shuffle_partitions=8)
    yield s
    s.stop()


def row(**kw):
    """A fact row with defaults; money given as numbers becomes Decimal."""
    base = dict(activity_date=D0, channel="StoreA", media="Search", campaign="c", ad_group="g",
                creative="cr", keyword="kw", brand="b1", product="p", promo=None,
                impressions=0, clicks=0, cost=0, rev_ss=0, rev_db=0, buy_ss=0, buy_db=0,
                rev_market_a=0, rev_market_b=0)
    base.update(kw)
    for m in ("cost", "rev_ss", "rev_db", "rev_market_a", "rev_market_b"):
        if base[m] is not None:
            base[m] = Decimal(str(base[m]))
    return tuple(base[f.name] for f in FACT_SCHEMA.fields)


@pytest.fixture
def make_fact(spark):
    def _make(rows):
        return spark.createDataFrame([row(**r) if isinstance(r, dict) else r for r in rows],
                                     FACT_SCHEMA)
    return _make


STORE_WORD = "StoreA"
MEDIA3 = ["Search", "Mkt", "Gm"]


@pytest.fixture
def sample_fact(make_fact):
    """5 days × 3 media, every day identical (measures depend on i)."""
    rows = []
    for day in range(5):
        for i, media in enumerate(MEDIA3):
            rows.append(dict(
                activity_date=D0 + dt.timedelta(days=day),
                channel=STORE_WORD if i == 0 else media, media=media,
                campaign=f"camp_{i}", ad_group=f"grp_{i}", creative=f"kw_{i}",
                keyword=f"sskw_{i}", brand="brand_a" if i % 2 == 0 else "brand_b",
                product=f"product_{i}", promo="always" if i == 0 else "promoA",
                impressions=1000 + i, clicks=100 + i, cost=10000 + 1000 * i,
                rev_ss=50000 + 2000 * i, rev_db=48000 + 2000 * i, buy_ss=5 + i, buy_db=4 + i,
                rev_market_a=3000 if i == 1 else 0, rev_market_b=2000 if i == 2 else 0))
    return make_fact(rows)
