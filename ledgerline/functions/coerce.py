"""Cell-level cleaning: typing, blanks, null tokens, key normalisation.

The conversions that run over every source field are SQL text, which builds
one column in one step; the wrappers take a column name or SQL expression.
Dates are zone-free (``timestamp_ntz``) and mean UTC, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that stands for "no value".
NULL_TOKENS = ["", "nan", "None"]

# Payment term codes and their days; any other code counts as the default.
PAYMENT_TERM_DAYS = {"Z001": 30, "Z009": 0}
DEFAULT_PAYMENT_DAYS = 30

# White space as Unicode defines it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)

_SPACE = "'" + "".join(f"\\u{ord(ch):04x}" for ch in WHITE_SPACE) + "'"
_OFFSET = r"r'(T| )(\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?([+-])(\d{2})(?::?(\d{2}))?$'"


def strip_sql(text: str) -> str:
    return f"trim(BOTH {_SPACE} FROM {text})"


def moment_sql(text: str) -> str:
    """ISO-8601 text to a zone-free UTC timestamp; NULL if it does not parse.

    Exports write "Z" or a bare date; the offset pattern runs on nothing else.
    Seconds, and the minutes of an offset, may be missing.
    """
    clock = f"try_cast({text} AS timestamp_ntz)"
    unit = f"if(regexp_extract({text}, {_OFFSET}, 4) = '-', -1, 1)"
    parts = [f"regexp_extract({text}, {_OFFSET}, {n})" for n in (5, 6)]
    hours, minutes = (f"{unit} * int(if({part} = '', '0', {part}))" for part in parts)
    seconds = f"if(regexp_extract({text}, {_OFFSET}, 3) = '', ':00', regexp_extract({text}, {_OFFSET}, 3))"
    bare = f"concat(regexp_replace({text}, {_OFFSET}, '$1$2'), {seconds})"
    return (
        f"CASE WHEN endswith({text}, 'Z') OR length({text}) <= 10 THEN {clock} "
        f"WHEN endswith({text}, 'z') THEN try_cast(concat(left({text}, length({text}) - 1), 'Z') AS timestamp_ntz) "
        f"WHEN rlike({text}, {_OFFSET}) "
        f"THEN try_cast({bare} AS timestamp_ntz) - make_dt_interval(0, {hours}, {minutes}) "
        f"ELSE {clock} END"
    )


def item_key_sql(text: str) -> str:
    """Item number without leading zeros, so padded and plain forms match."""
    return strip_sql(f"trim(LEADING '0' FROM {text})")


# How each kind of source field becomes a typed column, and the column's type.
KINDS = {
    "text": (lambda c: f"cast({c} AS string)", "string"),
    "number": (lambda c: f"try_cast({c} AS double)", "double"),
    "flag": (lambda c: f"try_cast({c} AS boolean)", "boolean"),
    "moment": (moment_sql, "timestamp_ntz"),
    "item": (item_key_sql, "string"),
}


def number(text: str) -> Column:
    """Text to double; what does not parse becomes NULL."""
    return F.expr(KINDS["number"][0](text))


def moment(text: str) -> Column:
    return F.expr(moment_sql(text))


def item_key(text: str) -> Column:
    return F.expr(item_key_sql(text))


def strip(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def not_blank(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def null_tokens(c: Column) -> Column:
    """The "no value" spellings become NULL."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def parse_or_null(text: str) -> Column:
    """Null tokens and unparsable text give NULL, ISO text a timestamp."""
    return F.when(~F.expr(text).isin(*NULL_TOKENS), moment(text))


def true_text(c: Column) -> Column:
    """"True" is true; "False", anything else and NULL are false."""
    return F.coalesce(c == "True", F.lit(False))


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    inf = float("inf")
    return F.when(~F.isnan(c) & (c != inf) & (c != -inf), c)


def json_safe(df: DataFrame) -> DataFrame:
    """Clear non-finite values from every floating-point column."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def flags_from_text(df: DataFrame) -> DataFrame:
    """Turn the text columns that carry flags into booleans."""
    return df.select(
        *[
            true_text(F.col(f.name)).alias(f.name)
            if (f.name.startswith("is_") or f.name == "missing_stage")
            and isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def from_text(name: str, target: T.DataType) -> Column:
    """One processed CSV column to its type."""
    if isinstance(target, T.BooleanType):
        return true_text(F.col(name))
    if isinstance(target, T.TimestampNTZType):
        return parse_or_null(name)
    if isinstance(target, T.LongType):  # day counts are stored as "3.0"
        return number(name).try_cast("bigint")
    return F.col(name) if isinstance(target, T.StringType) else F.col(name).try_cast(target)


def payment_term_days(
    c: Column,
    terms: dict[str, int] | None = None,
    default: int = DEFAULT_PAYMENT_DAYS,
) -> Column:
    """Days a payment term allows; unknown or missing terms get the default."""
    known = PAYMENT_TERM_DAYS if terms is None else terms
    days = F.lit(default).cast("bigint")
    for code, allowed in known.items():
        days = F.when(c == code, F.lit(allowed).cast("bigint")).otherwise(days)
    return days
