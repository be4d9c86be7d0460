"""Label expressions: missing-key bucket, valid-label test, truncation, paths,
promo classes and the channel rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adpulse.config import FigureConfig


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: All white space, as Unicode and the reference's strip() have it: also the
#: no-break and ideographic spaces that exports of this locale are full of.
WHITE_SPACE = "".join(chr(x) for x in range(0x3001) if chr(x).isspace())


def strip(c) -> Column:
    """Text without white space at both ends."""
    return F.trim(_c(c).cast("string"), F.lit(WHITE_SPACE))


def valid_label(c, cfg: FigureConfig | None = None) -> Column:
    """Not null, trimmed text not blank and not '-' (and not the missing label
    when a config is given)."""
    t = strip(c)
    bad = ["", "-"] + ([cfg.missing] if cfg is not None else [])
    return _c(c).isNotNull() & ~t.isin(*bad)


def truncate_label(c, n: int) -> Column:
    """First n characters plus an ellipsis when longer than n."""
    x = _c(c).cast("string")
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def path_label(parts: list, cfg: FigureConfig, fallback: str) -> Column:
    """'A > B' over the parts that are not null, blank, the missing label or 'nan'."""
    cleaned = [
        F.when(_c(p).isNull() | _c(p).isin("", cfg.missing, "nan"), F.lit(None)).otherwise(_c(p))
        for p in parts
    ]
    joined = F.concat_ws(" > ", *cleaned)
    return F.when(joined == "", F.lit(fallback)).otherwise(joined)


def promo_class(c, cfg: FigureConfig) -> Column:
    """always_on / promotion / unclassified from a promo name."""
    t = F.coalesce(strip(c), F.lit(""))
    return (F.when(t.contains(cfg.always_on_marker), F.lit("always_on"))
            .when(t != "", F.lit("promotion"))
            .otherwise(F.lit("unclassified")))


def is_store_channel(cfg: FigureConfig, col: str = "channel") -> Column:
    """Exact trimmed match on the store channel (null channel is not store)."""
    return F.coalesce(strip(col) == F.lit(cfg.store_channel), F.lit(False))


def is_market_channel(cfg: FigureConfig, col: str = "channel") -> Column:
    """Case-sensitive contains of the market marker (null channel is not market)."""
    return F.coalesce(F.col(col).contains(cfg.market_marker), F.lit(False))


def direction(delta, two_way: bool = False) -> Column:
    """'up' / 'down' / 'flat' by the sign of a delta; two-way form puts 0 in 'up'."""
    d = _c(delta)
    if two_way:
        return F.when(d >= 0, F.lit("up")).otherwise(F.lit("down"))
    return F.when(d > 0, F.lit("up")).when(d < 0, F.lit("down")).otherwise(F.lit("flat"))
