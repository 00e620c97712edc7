"""Row expressions the portal pages compute for display (rounding, date text, ranges, fallbacks, labels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workboard.functions.coerce import as_of_lit

# Request-kind labels shown on the release board (any other kind shows its raw value).
KIND_LABELS = {"infra": "Infraestructura", "erp": "ERP", "gen": "General"}

# The five canonical release states, in display order.
RELEASE_STATES = ["Planificado", "Aprobado", "En curso", "Completado", "Rollback"]

DASH = "—"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c) -> Column:
    """H17 ``Math.round``: floor(x + 0.5) as BIGINT (null stays null)."""
    return F.floor(_c(c) + F.lit(0.5)).cast("bigint")


def fmt_date(c, missing: str = DASH) -> Column:
    """H19 date text ``yyyy-MM-dd`` (UTC), or ``missing``."""
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd"), F.lit(missing))


def fmt_minute(c) -> Column:
    """H19 minute timestamp text ``yyyy-MM-dd HH:mm`` (UTC), or ``''``."""
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd HH:mm"), F.lit(""))


def date_range_text(start, end) -> Column:
    """H20 ``ini → fin`` with a dash for a missing end point (project cards)."""
    return F.concat(fmt_date(start), F.lit(" → "), fmt_date(end))


def window_text(start, end) -> Column:
    """H20 release window: start text, then ``' → ' + end`` only when the end exists; dash when both are missing."""
    s = F.when(_c(start).isNotNull(), fmt_minute(start)).otherwise(F.lit(""))
    e = F.when(_c(end).isNotNull(), F.concat(F.lit(" → "), fmt_minute(end))).otherwise(F.lit(""))
    return F.coalesce(F.nullif(F.concat(s, e), F.lit("")), F.lit(DASH))


def days_until(c, as_of) -> Column:
    """H21 whole days from ``as_of`` to a date (UTC midnight dates, so the ceiling equals the day difference)."""
    return F.datediff(_c(c), as_of_lit(as_of).cast("date"))


def title_or_ref(title, ref_id) -> Column:
    """H22 ``Titulo || '#' + SolicitudId``."""
    return F.coalesce(F.nullif(_c(title), F.lit("")), F.concat(F.lit("#"), _c(ref_id).cast("string")))


def dash_if_blank(c) -> Column:
    """H22 dash for missing text."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(DASH))


def kind_label(c) -> Column:
    """J5 label lookup as a literal map (3 fixed entries; no join needed): unknown kinds keep their raw value."""
    m = F.create_map(*[x for k, v in KIND_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(c)), _c(c))
