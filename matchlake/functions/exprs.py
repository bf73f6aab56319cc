"""Column expressions shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome labels of a two-sided event.
HOME_WIN, AWAY_WIN, DRAW = "HOME_WIN", "AWAY_WIN", "DRAW"

# Fixed value: absolute tolerance for numeric cell comparison between stores.
DEFAULT_TOLERANCE = 0.0011


def outcome(home: str | Column, away: str | Column) -> Column:
    """Three-way result; a NULL score falls through to DRAW, as in the reference model."""
    h, a = F.col(home) if isinstance(home, str) else home, F.col(away) if isinstance(away, str) else away
    return F.when(h > a, F.lit(HOME_WIN)).when(a > h, F.lit(AWAY_WIN)).otherwise(F.lit(DRAW))


def typed(c: Column, dtype: str, strict: bool = True) -> Column:
    """CAST (ANSI: bad text raises) or TRY_CAST (bad text becomes NULL)."""
    return c.cast(dtype) if strict else c.try_cast(dtype)


def iso_date(c: Column) -> Column:
    """Null-on-failure date coercion rendered as ISO text."""
    return F.date_format(F.try_to_date(c.cast("string")), "yyyy-MM-dd")


def tolerant_equal(a: Column, b: Column, eps: float | None) -> Column:
    """Both NULL = equal, one NULL = different, else |a-b| <= eps (or exact when eps is None)."""
    if eps is None:
        return a.eqNullSafe(b)
    close = F.abs(a.cast("double") - b.cast("double")) <= F.lit(eps)
    return F.coalesce(a.eqNullSafe(b) | close, F.lit(False))


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """Rounded ratio, NULL when the denominator is 0 or NULL."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), places)


# JSON numbers that parsing cannot keep: over 38 digits, or with an exponent
INEXACT_NUMBER = r"[0-9.]{39,}|[0-9][eE][+-]?[0-9]"


def canonical_text(c: Column, dtype) -> Column:
    """Text of one value that differs whenever the values differ (nothing is cut or rounded).

    Dates are ISO, timestamps carry microseconds, doubles their full precision (negative
    zero as zero), decimals their own digits, binary values hex digits. Nested values become
    JSON whose leaves follow the same rules (``nested_text``), JSON-looking text (an object
    or array) JSON with sorted keys, so that layout and key order do not matter; it stays as
    it is where a number in it has more than 38 digits or an exponent, which parsing could round.
    """
    from pyspark.sql import types as T
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("double").cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(c.isNotNull(), nested_text(c, dtype))
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, T.StringType):
        looks = c.rlike(r"^\s*[\[{]") & ~c.rlike(INEXACT_NUMBER)
        return F.coalesce(F.when(looks, F.to_json(F.try_parse_json(F.when(looks, c)))), c)
    return c.cast("string")


def nested_text(c: Column, dtype) -> Column:
    """JSON of a value of any type, never NULL: struct fields and map keys sorted, leaves by
    ``canonical_text`` (numbers and booleans bare, everything else quoted)."""
    from pyspark.sql import types as T
    # a JSON string: the only element of an array, without the brackets
    quote = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        parts = [F.concat(quote(F.lit(f.name)), F.lit(":"), nested_text(c.getField(f.name), f.dataType)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: nested_text(x, dtype.elementType)), ","), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        entry = lambda e: F.concat(quote(canonical_text(e["key"], dtype.keyType)), F.lit(":"), nested_text(e["value"], dtype.valueType))
        made = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), ","), F.lit("}"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType, T.VariantType)):
        made = canonical_text(c, dtype)
    else:
        made = quote(c if isinstance(dtype, T.StringType) else canonical_text(c, dtype))
    return F.when(c.isNotNull(), made).otherwise(F.lit("null"))


def number_key(c: Column, dtype) -> Column:
    """Text of a number that is the same for equal numbers of any numeric type, and for no others:
    plain digits without needless zeros (a double by its shortest digits). Text counts as the
    number it spells; NULL where it spells none."""
    from pyspark.sql import types as T
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if isinstance(dtype, T.IntegralType):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        return plain(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        long = F.abs(d) < 2.0 ** 63
        whole, fine = d.try_cast("decimal(38,0)"), d.try_cast("decimal(38,30)")
        return (F.when((d == F.rint(d)) & long, F.when(long, d).cast("bigint").cast("string"))
                .when(whole.cast("double") == d, whole.cast("string"))
                .when((F.abs(d) < 1e-3) & (fine.cast("double") == d), plain(fine.cast("string"))).otherwise(d.cast("string")))
    t = F.trim(c)
    part = lambda i: F.regexp_extract(t, r"^([+-]?)0*([0-9]+)(\.[0-9]*)?$", i)
    digits = plain(F.concat(part(2), part(3)))
    signed = F.when((part(1) == "-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), signed).otherwise(number_key(t.try_cast("double"), T.DoubleType()))


def first_path(js: Column, paths: list[str]) -> Column:
    """First non-NULL value among JSON paths (exact paths; a suffix match would be ambiguous)."""
    return F.coalesce(*[F.get_json_object(js, p) for p in paths])


def to_timestamp_ntz(c: Column) -> Column:
    """Date (or ISO text) → timestamp without time zone."""
    return c.cast("timestamp_ntz")
