"""A run of all figures: the three pages as named DataFrames.

``Figures`` takes the canonical fact of ONE snapshot (see
``sources.snapshots``), resolves its anchors once and hands out every figure
of the summary, product and media pages as a lazy DataFrame. Nothing is
collected except the one-row anchors; each figure is its own Spark plan, and
the caller decides what to run (``.write``, ``.toPandas`` of a small result,
...).

``persist=True`` keeps the fact's projected columns cached for the run, the
equivalent of the reference app's in-process cache of the loaded snapshot;
leave it off for very large snapshots stored date-partitioned, where every
figure prunes to the days it needs instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from adpulse.config import FigureConfig
from adpulse.functions.measures import day_between
from adpulse.operators import dimensions, drivers, kpi, periods, products, promo, ranking, totals
from adpulse.operators.anchors import Anchors, resolve_anchors
from adpulse.operators.compare import two_day_compare


class Figures:
    def __init__(self, fact: DataFrame, cfg: FigureConfig, targets: DataFrame | None = None,
                 brand: str | None = None, persist: bool = False,
                 anchors: Anchors | None = None, cache_recent: bool = False,
                 campaign: str | None = None, ad_group: str | None = None):
        self.cfg = cfg
        self.brand = brand
        # the creative tables' campaign and group, if chosen
        self.creative_of = (campaign, ad_group)
        self.targets = targets
        self.fact = fact.persist(StorageLevel.MEMORY_AND_DISK) if persist else fact
        self._persisted = persist
        # Anchors come from the unfiltered fact even when a brand is chosen.
        self.anchors = anchors or resolve_anchors(self.fact)
        # Most figures read only recent days: month to date, the previous
        # available day, the calendar day before and the same weekday a week
        # back. ``cache_recent`` keeps that slice once for the run; figures
        # over the whole history still read ``fact``.
        a = self.anchors
        lo = min(a.month_start, a.d_prev, a.calendar_prev, a.same_weekday)
        recent = self.fact.where(day_between(lo, a.d_max))
        self.recent = recent.persist(StorageLevel.MEMORY_AND_DISK) if cache_recent else recent
        self._recent_cached = cache_recent
        # Whole-history keys for the choice lists: read once where kept.
        keys = dimensions.choice_keys(self.fact, cfg)
        self.keys = keys.persist(StorageLevel.MEMORY_AND_DISK) if cache_recent else keys

    def close(self) -> None:
        if self._recent_cached:
            self.recent.unpersist()
            self.keys.unpersist()
        if self._persisted:
            self.fact.unpersist()

    # ── summary page ─────────────────────────────────────────────────────
    def summary(self, base: tuple[dt.date, dt.date] | None = None,
                comp: tuple[dt.date, dt.date] | None = None,
                trend_end: dt.date | None = None, trend_days: int = 7,
                trend_range: tuple[dt.date, dt.date] | None = None) -> dict[str, DataFrame]:
        f, r, a, c, b = self.fact, self.recent, self.anchors, self.cfg, self.brand
        trend = (totals.roas_trend_between(f, *trend_range) if trend_range
                 else totals.roas_trend(f, trend_end or a.d_max, trend_days, a))
        # Chosen ranges may reach before the recent slice.
        pd_src = r if base is None and comp is None else f
        pages = {
            "mtd_basis_table": totals.basis_table(totals.mtd_totals(r, a, b)),
            "daily_detail": totals.daily_detail(r, a, b),
            "period_delta": periods.period_delta(pd_src, base, comp, a, b),
            "roas_trend": trend,
            "daily_headline": periods.daily_headline(r, a),
            "channel_headline": drivers.channel_headline(r, c, a),
            "channel_drivers": drivers.channel_drivers(r, c, a, c.k_drivers),
            "media_product_drivers": drivers.media_product_drivers(r, c, a, c.k_drivers, c.k_drivers),
            "display_media_breakdown": drivers.display_media_breakdown(r, c, a),
            "media_campaign_drivers": drivers.media_campaign_drivers(r, c, a, c.k_drivers),
            "media_summary": drivers.media_summary(r, c, a),
        }
        if self.targets is not None:
            pages["kpi_attainment"] = kpi.kpi_attainment(r, self.targets, c, a)
        return pages

    # ── products page ────────────────────────────────────────────────────
    def product_page(self) -> dict[str, DataFrame]:
        f, a, c, b = self.recent, self.anchors, self.cfg, self.brand
        k = c.k_products
        return {
            "mtd_top_products": ranking.mtd_top_products(f, c, a, k, b),
            "product_gainers": products.product_movers(f, c, a, True, c.k_gainers, b),
            "product_losers": products.product_movers(f, c, a, False, c.k_gainers, b),
            "media_top_products_mtd": ranking.media_top_products(f, c, a, k, False, b),
            "media_top_products_day": ranking.media_top_products(f, c, a, k, True, b),
            "media_product_gainers": products.media_product_movers(f, c, a, True, c.k_gainers, b),
            "media_product_losers": products.media_product_movers(f, c, a, False, c.k_gainers, b),
        }

    # ── media page ───────────────────────────────────────────────────────
    def media_page(self) -> dict[str, DataFrame]:
        r, a, c, b = self.recent, self.anchors, self.cfg, self.brand
        return {
            "media_mtd": totals.media_mtd(r, a, b),
            "campaign_mtd_top": ranking.campaign_mtd_top(r, a, c.k_campaign_mtd, b),
            "campaign_change_top": drivers.campaign_change_top(r, c, a, c.k_detail, b),
            "keyword_mtd_top": ranking.keyword_mtd_top(r, c, a, c.k_detail, b),
            "keyword_change_top": drivers.keyword_change_top(r, c, a, c.k_detail, b),
            "creative_mtd_top": ranking.creative_mtd_top(r, c, a, c.k_detail, *self.creative_of, b),
            "creative_change_top": drivers.creative_change_top(r, c, a, c.k_detail, *self.creative_of, b),
            # Choice lists come from the whole history.
            "dimension_values": dimensions.dimension_values(self.keys),
            "cascading_filter": dimensions.cascading_filter(self.keys, c),
        }

    # ── figures defined by the reference but not placed on a page ──────
    def extras(self) -> dict[str, DataFrame]:
        r, a, c = self.recent, self.anchors, self.cfg
        top10 = products.product_top10(r, c, a, k=c.k_products)
        return {
            # The standard periods of the last day reach back 7 days at most.
            "multi_period": periods.multi_period(r, anchors=a),
            "multi_period_delta_ss": periods.multi_period_delta(r, "ss", anchors=a),
            "multi_period_delta_db": periods.multi_period_delta(r, "db", anchors=a),
            # A promo class counts when it has rows on any day: whole history.
            "promo_split": promo.promo_split(r, c, a, history=self.keys),
            "product_top10": top10,
            "product_top10_summary": products.product_top10_summary(top10),
            "media_daily_pivot_mtd": totals.media_daily_pivot(r, a.month_start, a.d_max),
            "compare_media_ss": two_day_compare(r, ["media"], "ss", a.d_max, a.d_prev, c),
            "drilldown_tree": drivers.drilldown_tree(r, c, a, c.k_drivers),
        }

    def all_figures(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for page in (self.summary, self.product_page, self.media_page, self.extras):
            out.update(page())
        return out

    def write_all(self, out_dir: str, writer: Callable[[DataFrame, str], None] | None = None,
                  parallel: int = 1) -> list[str]:
        """Materialise every figure as Parquet under ``out_dir/<figure>``.

        Figures are independent Spark jobs; with ``parallel`` > 1 they are
        submitted from that many driver threads so small jobs overlap on the
        cluster instead of queueing one after another. Each write overwrites
        its own folder, so a rerun after a failure is safe.
        """
        write = writer or (lambda df, p: df.write.mode("overwrite").parquet(p))
        figures = self.all_figures()
        dest = {name: f"{out_dir.rstrip('/')}/{name}" for name in figures}
        if parallel <= 1:
            for name, df in figures.items():
                write(df, dest[name])
        else:
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                futures = [pool.submit(write, df, dest[name]) for name, df in figures.items()]
                for fut in futures:
                    fut.result()
        return sorted(figures)
