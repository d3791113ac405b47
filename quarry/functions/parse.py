"""Text-to-type parsing expressions (all JVM-side column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boolean tokens (compared lower-cased and trimmed).
BOOL_TRUTHY = ("true", "yes", "1", "t", "y", "on")
BOOL_FALSY = ("false", "no", "0", "f", "n", "off")
BOOL_ALL = BOOL_TRUTHY + BOOL_FALSY

# Name fragments that suggest a datetime column, strongest first.
DATETIME_NAME_HINTS = (
    "timestamp", "datetime", "date_time", "date", "time", "created_at", "updated_at",
    "recorded_at", "event_time", "period", "month", "year", "day",
)
DATETIME_PARSE_THRESHOLD = 0.60
NUMERIC_PARSE_THRESHOLD = 0.70

# Candidate datetime layouts (Spark pattern, equivalent strptime pattern for the SQL oracle,
# shape).  Month before day where both fit.  A shape is a superset of what its layout accepts: values that
# cannot match skip the formatter, whose failures are expensive.
_D, _CLOCK, _ZONE = r"\d{1,2}", r"\d{1,2}:\d{2}:\d{2}", r"\s?(Z|[+-]\d{2}:?\d{2})"
DATETIME_LAYOUTS = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", rf"^\d{{4}}-{_D}-{_D} {_D}:{_D}:{_D}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", rf"^\d{{4}}-{_D}-{_D}T{_D}:{_D}:{_D}$"),
    ("yyyy-MM-dd", "%Y-%m-%d", rf"^\d{{4}}-{_D}-{_D}$"),
    ("MM/dd/yyyy", "%m/%d/%Y", rf"^{_D}/{_D}/\d{{4}}$"),
    ("dd.MM.yyyy", "%d.%m.%Y", rf"^{_D}\.{_D}\.\d{{4}}$"),
    ("yyyy/MM/dd", "%Y/%m/%d", rf"^\d{{4}}/{_D}/{_D}$"),
    ("dd/MM/yyyy", "%d/%m/%Y", rf"^{_D}/{_D}/\d{{4}}$"),
    ("MM-dd-yyyy", "%m-%d-%Y", rf"^{_D}-{_D}-\d{{4}}$"),
    ("dd-MM-yyyy", "%d-%m-%Y", rf"^{_D}-{_D}-\d{{4}}$"),
    ("MMM d, yyyy", "%b %d, %Y", rf"^[A-Za-z]{{3}} {_D}, \d{{4}}$"),
    ("d MMM yyyy", "%d %b %Y", rf"^{_D} [A-Za-z]{{3}} \d{{4}}$"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", rf"^\d{{4}}-{_D}-{_D} {_D}:\d{{2}}$"),
    ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M", rf"^\d{{4}}-{_D}-{_D}T{_D}:\d{{2}}$"),
    ("MM/dd/yyyy HH:mm[:ss]", "%m/%d/%Y %H:%M:%S", rf"^{_D}/{_D}/\d{{4}} {_D}:\d{{2}}(:\d{{2}})?$"),
    ("dd/MM/yyyy HH:mm[:ss]", "%d/%m/%Y %H:%M:%S", rf"^{_D}/{_D}/\d{{4}} {_D}:\d{{2}}(:\d{{2}})?$"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "%Y-%m-%d %H:%M:%S.%f", rf"^\d{{4}}-{_D}-{_D} {_CLOCK}\.\d{{1,9}}$"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS", "%Y-%m-%dT%H:%M:%S.%f", rf"^\d{{4}}-{_D}-{_D}T{_CLOCK}\.\d{{1,9}}$"),
    ("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][ ][XXX][XX]", "%Y-%m-%d %H:%M:%S%z", rf"^\d{{4}}-{_D}-{_D} {_CLOCK}(\.\d{{1,9}})?{_ZONE}$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][ ][XXX][XX]", "%Y-%m-%dT%H:%M:%S%z", rf"^\d{{4}}-{_D}-{_D}T{_CLOCK}(\.\d{{1,9}})?{_ZONE}$"),
)
DATETIME_FORMATS = tuple((spark, sql) for spark, sql, _ in DATETIME_LAYOUTS)
DATETIME_SHAPES = {spark: shape for spark, _, shape in DATETIME_LAYOUTS}

# Currency signs and the shape of European numbers.
CURRENCY = "$£€¥₹"
EURO_PATTERN = r"^\d{1,3}(\.\d{3})+(,\d+)?$"


def text(c: Column) -> Column:
    return c.cast("string")


def numeric_body(c: Column) -> Column:
    """Strip blanks, sign, one currency symbol and a trailing percent (one regex)."""
    return F.regexp_extract(F.trim(text(c)), rf"^[+\-]?\s*[{CURRENCY}]?\s*(.*?)\s*%?$", 1)


def is_negative(c: Column) -> Column:
    return F.trim(text(c)).startswith("-")


def euro_row(c: Column) -> Column:
    """A value that can only be read as European notation (dot groups + comma decimals, or >= 2 dot groups)."""
    b = numeric_body(c)
    return b.rlike(EURO_PATTERN) & (b.contains(",") | b.rlike(r"\.\d{3}\.\d{3}"))


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def parse_numeric_body(b: Column, negative: Column, european: Column | bool, keep_sign: bool = True) -> Column:
    """``parse_numeric`` on an already stripped body (see ``numeric_body``)."""
    eu = F.translate(F.translate(b, ".", ""), ",", ".")
    plain = F.translate(b, ",", "")
    eu_flag = F.lit(european) if isinstance(european, bool) else european
    cleaned = F.when(eu_flag, F.when(b.rlike(EURO_PATTERN), eu).otherwise(b)).otherwise(plain)
    # no number is without digits or has one of these signs behind a digit; a cast that fails costs an exception
    x = _finite(F.when(cleaned.rlike("[0-9]") & ~cleaned.rlike("[0-9][-:/]"), cleaned.try_cast("double")))
    return F.when(negative & F.lit(keep_sign), -x).otherwise(x)


def euro_body(b: Column) -> Column:
    return b.rlike(EURO_PATTERN) & (b.contains(",") | b.rlike(r"\.\d{3}\.\d{3}"))


def parse_numeric(c: Column, european: Column | bool, keep_sign: bool = True) -> Column:
    """B1: text -> DOUBLE.  ``european`` is the column-level flag (any ``euro_row``).

    In a European column, values in that notation lose their dots and use ``,``
    as decimal point; other values keep their commas (and fail, as in the
    reference).  Otherwise commas are thousands separators.  NaN/Inf -> NULL.
    ``keep_sign=False`` reproduces the reference, which drops a leading minus.
    """
    return parse_numeric_body(numeric_body(c), is_negative(c), european, keep_sign)


def is_bool_token(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin(*BOOL_ALL)


def to_bool(c: Column, null_as_false: bool = True) -> Column:
    """Truthy token -> true; anything else false; NULL -> false (or NULL)."""
    v = F.lower(F.trim(text(c))).isin(*BOOL_TRUTHY)
    return F.coalesce(v, F.lit(False)) if null_as_false else v


def parse_datetime(c: Column, fmt: str) -> Column:
    """TIMESTAMP_NTZ for one layout, NULL when it does not match.

    Text without a zone keeps its wall clock; text with an offset is converted to UTC.
    """
    parsed = parse_dated(c, fmt)
    return F.when(looks_like_date(c), parsed) if fmt in DATETIME_SHAPES else parsed


def parse_dated(c: Column, fmt: str) -> Column:
    """``parse_datetime`` of a value that is known to look like a date."""
    parsed = F.try_to_timestamp(text(c), F.lit(fmt))
    if "X" in fmt:
        parsed = F.to_utc_timestamp(parsed, F.current_timezone())
    parsed = parsed.cast("timestamp_ntz")
    shape = DATETIME_SHAPES.get(fmt)
    return parsed if shape is None else F.when(text(c).rlike(shape), parsed)


def parse_any_datetime(c: Column, first: str | None = None) -> Column:
    """C4: the column's main layout first, then the other layouts in their order, per value."""
    layouts = [f for f, _ in DATETIME_FORMATS]
    known = ([first] if first in layouts else []) + [f for f in layouts if f != first]
    parsed = F.when(looks_like_date(c), F.coalesce(*[parse_dated(c, f) for f in known]))     # one test for all layouts
    return F.coalesce(parse_datetime(c, first), parsed) if first and first not in layouts else parsed


def looks_like_date(c: Column) -> Column:
    """One cheap test shared by all layouts: digits, a separator, digits, a separator; or a day, a month name and a year."""
    return text(c).rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d|^([A-Za-z]{3} \d{1,2},|\d{1,2} [A-Za-z]{3}) \d{4}$")


def name_score(name: str) -> float:
    low = name.lower()
    for i, hint in enumerate(DATETIME_NAME_HINTS):
        if hint in low:
            return 1.0 - (i / len(DATETIME_NAME_HINTS)) * 0.5
    return 0.0


def normalize_name(name: str) -> str:
    """A2: strip, lower-case, runs of blanks/dashes -> '_'."""
    import re

    return re.sub(r"[\s\-]+", "_", name.strip().lower())
