"""Configuration: labels, channel rules and media sets.

Everything a rule needs to recognise (a store channel, a marketplace
channel, the display media, the always-on promo marker) is data here, so the
same operators serve any locale's data and the synthetic test mapping.
"""

from __future__ import annotations

from dataclasses import dataclass

# ── Fixed values: must equal the reference's labels ─────────────────
MISSING_LABEL = "(미입력)"                 # bucket for a missing group key
STORE_CHANNEL = "네이버브랜드스토어"         # exact channel name of the brand store
STORE_MARKER = "네이버"                     # store rows (KPI rule, case-insensitive)
STORE_TARGET_ALIASES = ("naver", "네이버")  # target names attained by store revenue
MARKET_MARKER = "쿠팡"                      # marketplace rows / media
MARKET_TARGET_NAMES = ("쿠팡",)             # target names (exact) attained by marketplace revenue
MARKET_TARGET_ALIASES = ("coup",)           # ... or containing one of these
OTHER_TARGET = "othermall"                  # target attained by everything else
PRODUCT_EXCLUDED_MEDIA = "쿠팡|G마켓"        # media removed from the product pages
DISPLAY_MARKER = "성과형디스플레이"          # media that get the display breakdown
DISPLAY_SUB_MEDIA = ("네이버 메인배너", "네이버 쇼핑프로모션", "네이버 스마트채널")
KEYWORD_MEDIA = ("네이버 파워링크", "네이버 쇼핑검색", "네이버 브랜드검색", "네이버 신제품검색")
CREATIVE_MEDIA = ("네이버 쇼핑프로모션", "네이버 스마트채널", "네이버 메인배너")
ALWAYS_ON_MARKER = "상시"                   # promo name marking always-on spend
PATH_FALLBACK_DRIVER = "(기타)"             # campaign > group path with no parts
PATH_FALLBACK_SUMMARY = "-"                 # same, in the media summary
LABEL_LEN_LONG, LABEL_LEN_SHORT = 50, 35    # label truncation lengths
BAND_GREEN, BAND_AMBER = 80.0, 50.0         # attainment bands, percent
K_PRODUCTS, K_CAMPAIGN_MTD, K_DETAIL, K_DRIVERS, K_GAINERS = 10, 30, 20, 3, 10
# ────────────────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class FigureConfig:
    missing: str = MISSING_LABEL
    store_channel: str = STORE_CHANNEL
    store_marker: str = STORE_MARKER
    # A target row whose lower-cased, trimmed name equals store_channel or
    # contains one of these is attained by store revenue.
    store_target_aliases: tuple[str, ...] = STORE_TARGET_ALIASES
    market_marker: str = MARKET_MARKER
    # A target row whose lower-cased, trimmed name is one of the names or
    # contains one of the aliases is attained by marketplace revenue.
    market_target_names: tuple[str, ...] = MARKET_TARGET_NAMES
    market_target_aliases: tuple[str, ...] = MARKET_TARGET_ALIASES
    other_target: str = OTHER_TARGET
    # Regular expression on the media name.
    product_excluded_media: str = PRODUCT_EXCLUDED_MEDIA
    display_marker: str = DISPLAY_MARKER
    display_sub_media: tuple[str, ...] = DISPLAY_SUB_MEDIA
    keyword_media: tuple[str, ...] = KEYWORD_MEDIA
    creative_media: tuple[str, ...] = CREATIVE_MEDIA
    # Promo classification: a name containing the marker is always-on, any
    # other non-blank name is a promotion, blank/null is unclassified.
    always_on_marker: str = ALWAYS_ON_MARKER
    path_fallback_driver: str = PATH_FALLBACK_DRIVER
    path_fallback_summary: str = PATH_FALLBACK_SUMMARY
    label_len_long: int = LABEL_LEN_LONG
    label_len_short: int = LABEL_LEN_SHORT
    band_green: float = BAND_GREEN
    band_amber: float = BAND_AMBER
    k_products: int = K_PRODUCTS
    k_campaign_mtd: int = K_CAMPAIGN_MTD
    k_detail: int = K_DETAIL
    k_drivers: int = K_DRIVERS
    k_gainers: int = K_GAINERS


DEFAULT_CONFIG = FigureConfig()

# Labels of the synthetic mapping of the driver tables (sources/tpch_fact.py).
TEST_CONFIG = FigureConfig(
    missing="(missing)",
    store_channel="storefront",
    store_marker="storefront",
    store_target_aliases=("storefront", "store"),
    market_marker="market_a",
    market_target_names=("market_a",),
    market_target_aliases=("mkt",),
    other_target="othermall",
    product_excluded_media="NATION_12",
    display_marker="NATION_1",
    display_sub_media=("NATION_5", "NATION_0", "NATION_10", "NATION_23"),
    keyword_media=("NATION_7", "NATION_22", "NATION_17", "NATION_9", "NATION_8"),
    creative_media=("NATION_6", "NATION_11", "NATION_2", "NATION_20"),
    always_on_marker="always_on",
    path_fallback_driver="(other)",
)
