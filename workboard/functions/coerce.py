"""Row-level coercions applied to request fields before they are written.

All helpers return native ``Column`` expressions (JVM-side, whole-stage codegen) — no Python UDFs. The rules follow
the portal's JavaScript helpers: trim with the JavaScript whitespace set, empty → null, cut to a maximum length,
``Number()``-style numbers, two different integer rules (truncating vs. ``parseInt`` prefix), ISO date parsing in
UTC, yes/no and bit flags that depend on the JSON value type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript String.prototype.trim whitespace set (WhiteSpace + LineTerminator code points):
# U+0009-U+000D, U+0020, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF.
JS_WS = (
    "[\\x{0009}-\\x{000D}\\x{0020}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)
# The same set as plain characters, for Spark's character-set ``trim`` (no regex, so it is cheap per row).
JS_WS_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")

# Decimal literal accepted by JavaScript Number() (after trimming).
_DEC_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_HEX_RE = "^0[xX][0-9a-fA-F]+$"

INT_MIN, INT_MAX = -2147483648, 2147483647


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim JavaScript whitespace at both ends (Spark's default ``trim`` strips only U+0020)."""
    return F.trim(_c(c).cast("string"), F.lit(JS_WS_CHARS))


def clean_text(c, max_len: int | None = None) -> Column:
    """H1 ``str(v, max)``: null → null; trim; empty → null; keep the first ``max_len`` characters."""
    t = F.nullif(js_trim(c), F.lit(""))
    if max_len:
        t = F.substring(t, 1, max_len)
    return t


def default_if_blank(c, default: str, max_len: int | None = None) -> Column:
    """H7: cleaned text, or ``default`` when null/blank."""
    return F.coalesce(clean_text(c, max_len), F.lit(default))


def to_num(c) -> Column:
    """H2 ``Number(v)`` with ``''`` → null and NaN → null.

    Blank-but-not-empty text is 0 (as in JavaScript), decimal and exponent forms, ``0x`` hex and ``±Infinity`` are
    accepted; anything else (including Java-only forms such as ``1d``) is null.
    """
    raw = _c(c).cast("string")
    t = js_trim(raw)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("double"))
        .when(t == "", F.lit(0.0))
        .when(t.rlike(_DEC_RE), t.try_cast("double"))
        .when(t.rlike(_HEX_RE), F.conv(F.substring(t, 3, 64), 16, 10).try_cast("double"))
        .when(t.isin("Infinity", "+Infinity"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
    )


def to_int_trunc(c) -> Column:
    """H3 ``Math.trunc(Number(v))`` as a 32-bit INT; infinite or out-of-range values are null (rejected)."""
    n = to_num(c)
    return F.when((n > INT_MIN - 1) & (n < INT_MAX + 1), n.cast("int"))


def to_int_prefix(c) -> Column:
    """H4 ``parseInt(v, 10)``: leading blanks, optional sign, then digits ('12abc' → 12, '1e3' → 1, 'x' → null).

    ``''`` is null; results outside the 32-bit range are null.
    """
    raw = _c(c).cast("string")
    digits = F.regexp_extract(F.ltrim(raw, F.lit(JS_WS_CHARS)), "^([+-]?[0-9]+)", 1)
    return F.when(raw != "", digits.try_cast("int"))


def to_id(c) -> Column:
    """An id by the same prefix rule as :func:`to_int_prefix`, as BIGINT; null when blank, not a number or too large
    (see :func:`id_too_large`)."""
    raw = _c(c).cast("string")
    digits = F.regexp_extract(F.ltrim(raw, F.lit(JS_WS_CHARS)), "^([+-]?[0-9]+)", 1)
    return F.when(raw != "", digits.try_cast("bigint"))


def leading_int(c) -> Column:
    """The text of the integer a value starts with (``''`` if none), staged by rules that read an id more than once."""
    return F.regexp_extract(F.ltrim(_c(c).cast("string"), F.lit(JS_WS_CHARS)), "^([+-]?[0-9]+)", 1)


def id_text_too_large(*cs) -> Column:
    """:func:`id_too_large` of texts from :func:`leading_int`."""
    out = F.lit(False)
    for c in cs:
        out = out | F.coalesce((_c(c) != "") & _c(c).try_cast("bigint").isNull(), F.lit(False))
    return out


def id_too_large(*cs) -> Column:
    """Whether any of the values starts with an integer that no BIGINT holds."""
    out = F.lit(False)
    for c in cs:
        found = F.ltrim(_c(c).cast("string"), F.lit(JS_WS_CHARS)).rlike("^[+-]?[0-9]+")
        out = out | F.coalesce(found & to_id(c).isNull(), F.lit(False))
    return out


def to_id_trunc(c) -> Column:
    """An id by the truncating rule of :func:`to_int_trunc`, as BIGINT: plain integers exactly, other forms through
    ``Number()`` while it holds integers exactly."""
    t = js_trim(c)
    n = to_num(c)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint")).otherwise(
        F.when(F.abs(n) <= 9007199254740991.0, n.cast("bigint")))


def number_out_of_range(c, precision: int, scale: int) -> Column:
    """Whether a value is a number that DECIMAL(p,s) cannot hold."""
    n = to_num(c)
    return F.coalesce(n.isNotNull() & (F.abs(n) >= 10.0 ** (precision - scale)), F.lit(False))


def clamp_progress(c) -> Column:
    """H6 ``clampProg``: parseInt then clamp to 0..100; null stays null."""
    return clamp(to_int_prefix(c))


def clamp(n) -> Column:
    """The clamp of :func:`clamp_progress` for a number already read."""
    n = _c(n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), n)))


def to_decimal(c, precision: int, scale: int) -> Column:
    """H2 then DECIMAL(p,s); values out of range (and ±Infinity) become null."""
    n = to_num(c)
    bound = 10.0 ** (precision - scale)
    return F.when(n.isNotNull() & (F.abs(n) < bound), n.try_cast(f"decimal({precision},{scale})"))


# ISO-8601 forms accepted by the date helper: date, optional time (T or blank), optional fraction and zone.
_ISO_RE = (
    "^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    "(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,9}))?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
)


def as_of_lit(as_of) -> Column:
    """A fixed "now" (``datetime``/``date``/ISO text) as a TIMESTAMP_NTZ literal, independent of any time zone."""
    text = as_of.isoformat(sep=" ") if hasattr(as_of, "isoformat") and not isinstance(as_of, str) else str(as_of)
    return F.lit(text).cast("timestamp_ntz")


def now_utc() -> Column:
    """The current instant as a UTC wall-clock TIMESTAMP_NTZ (``SYSUTCDATETIME()``)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def to_timestamp_utc(c, cleaned: bool = False) -> Column:
    """H5 ``new Date(v)`` for ISO text, as a UTC TIMESTAMP_NTZ with millisecond precision.

    Date-only text is UTC midnight; a time without zone is taken as UTC (the service runs in UTC); ``Z`` / ``±hh:mm``
    offsets are applied. Impossible dates (``2026-02-31``) and non-ISO text are null. One regex gate, then Spark's
    own ISO casts: zone-less text straight to TIMESTAMP_NTZ, zoned text to an instant shown in UTC — so the result
    does not depend on the session time zone. ``cleaned=True`` takes text already passed through
    :func:`clean_text` (stage it as a column first: the text is referenced several times here).
    """
    return F.date_trunc("millisecond", _utc(c, cleaned)).cast("timestamp_ntz")


def _utc(c, cleaned: bool) -> Column:
    t = _c(c) if cleaned else clean_text(c)
    # asked of ISO text only: after the ten characters of the day, a sign can only be that of a zone
    zoned = (F.length(t) > 10) & (t.endswith("Z") | F.substring(t, -6, 1).isin("+", "-"))
    # zone-less text is a UTC wall clock already: a TIMESTAMP_NTZ cast reads it without any session zone
    local = t.try_cast("timestamp_ntz")
    # zoned text is an instant (the cast needs seconds before a zone, so a minute-only time gets ':00'),
    # then shown as its UTC wall clock
    instant = F.coalesce(t.try_cast("timestamp"),
                         F.regexp_replace(t, "^(.{16})", "$1:00").try_cast("timestamp"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.when(t.rlike(_ISO_RE), F.when(zoned, utc).otherwise(local))


def to_date_utc(c, cleaned: bool = False) -> Column:
    """H5 for DATE columns: the UTC calendar day of :func:`to_timestamp_utc`."""
    return _utc(c, cleaned).cast("date")


def date_or_now(c, as_of, cleaned: bool = False) -> Column:
    """The supplied timestamp when it parses, else ``as_of`` (the batch's "now")."""
    return F.coalesce(to_timestamp_utc(c, cleaned), as_of_lit(as_of))


# --- JSON-typed flags and lists (the value type matters, so these take a VARIANT field) ---------------------------

def jtype(v: Column) -> Column:
    """Type name of a VARIANT value: OBJECT, ARRAY, VOID (JSON null), or the scalar type (STRING, BIGINT, DECIMAL(..),
    DOUBLE, BOOLEAN); SQL null when the member is missing.

    Containers are recognised by cheap casts (to an empty struct / an array of variants) so ``schema_of_variant``,
    which walks the whole value, only ever runs on scalars.
    """
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.is_variant_null(v), F.lit("VOID"))
            .when(F.try_variant_get(v, "$", "struct<>").isNotNull(), F.lit("OBJECT"))
            .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
            .otherwise(F.schema_of_variant(v)))


def jstr(v: Column, t: Column | None = None) -> Column:
    """JavaScript ``String(v)`` of a scalar JSON value (JSON null and missing → null; ``t`` is not needed)."""
    return F.try_variant_get(v, "$", "string")


def _is_number(t: Column) -> Column:
    return t.startswith("BIGINT") | t.startswith("INT") | t.startswith("DECIMAL") | t.startswith("DOUBLE") \
        | t.startswith("FLOAT") | t.startswith("SMALLINT") | t.startswith("TINYINT")


def yes_no(v: Column, t: Column | None = None) -> Column:
    """H9: JSON ``true``, text ``'Sí'`` or ``'si'`` → ``'Sí'``; anything else → ``'No'``."""
    t = jtype(v) if t is None else t
    s = F.try_variant_get(v, "$", "string")
    yes = ((t == "BOOLEAN") & (s == "true")) | ((t == "STRING") & s.isin("Sí", "si"))
    return F.when(F.coalesce(yes, F.lit(False)), F.lit("Sí")).otherwise(F.lit("No"))


def truthy(v: Column, t: Column | None = None) -> Column:
    """JavaScript truthiness of a JSON value (``"0"`` and ``"false"`` are truthy; 0, '', null are not)."""
    t = jtype(v) if t is None else t
    return F.coalesce(
        F.when(t.isNull() | (t == "VOID"), F.lit(False))
        .when(t.isin("OBJECT", "ARRAY"), F.lit(True))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "string") == "true")
        .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(_is_number(t), (F.try_variant_get(v, "$", "double") != 0)
              & ~F.isnan(F.try_variant_get(v, "$", "double")))
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def strict_bit(v: Column, t: Column | None = None) -> Column:
    """``true``, ``1`` or ``'1'`` → true; anything else → false."""
    t = jtype(v) if t is None else t
    s = F.try_variant_get(v, "$", "string")
    num = F.try_variant_get(v, "$", "double")
    hit = ((t == "BOOLEAN") & (s == "true")) | ((t == "STRING") & (s == "1")) | (_is_number(t) & (num == 1))
    return F.coalesce(hit, F.lit(False))


def join_list(v: Column, sep: str, max_len: int | None = None, t: Column | None = None, collect: bool = False) -> Column:
    """H8 ``joinList``: an array drops falsy items and joins (may give ``''``); any other value → :func:`clean_text`.

    Falsy array items are null, ``''``, ``false`` and numeric 0. Items are not trimmed, unless ``collect``: then they are first
    collected as the portal's form does (H26, :func:`trim_list`), for bodies that did not pass through it.
    """
    t = jtype(v) if t is None else t
    arr = F.try_variant_get(v, "$", "array<variant>")
    items = F.transform(arr, lambda x: F.when(truthy(x), F.try_variant_get(x, "$", "string")))
    joined = F.array_join(trim_list(items) if collect else items, sep)  # skips the nulls left by falsy items
    out = F.when(t == "ARRAY", joined).otherwise(clean_text(jstr(v, t)))
    return F.substring(out, 1, max_len) if max_len else out


_NUM_TEXT_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strict_bit_text(c) -> Column:
    """H11 for a field that arrives as JSON text (form bodies): ``true``, a number equal to 1, or ``"1"`` → true.

    Same result as :func:`strict_bit` on the parsed value, without building a VARIANT per row.
    """
    t = js_trim(c)
    num = F.when(t.rlike(_NUM_TEXT_RE), t.try_cast("double"))
    return F.coalesce((t == "true") | (t == '"1"') | (num == 1), F.lit(False))


def trim_list(arr: Column) -> Column:
    """Form-side list collection — trim every entry and drop the null and empty ones."""
    return F.filter(F.transform(arr, lambda x: js_trim(x)), lambda x: x != "")
