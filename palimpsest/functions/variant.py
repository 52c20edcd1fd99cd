"""Values of JSON by their type, through VARIANT: strings, numbers, booleans and nulls stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers as text that count as numbers: signs, digits in groups, exponents, white space around.
_NUMBER = r"[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?"


def parsed(text: Column) -> Column:
    """JSON as VARIANT; null if it cannot be read, or an object names a member twice."""
    return F.try_parse_json(text)


def member(value: Column, name: str) -> Column:
    """A member of an object: null if it is missing, and a VARIANT null if it is null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """string, number, boolean, null, object or array; missing for SQL's null."""
    name = F.lower(F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0))
    return F.coalesce(F.regexp_replace(F.regexp_replace(name, "^(?:bigint|decimal|double|float)$", "number"), "^void$", "null"), F.lit("missing"))


def with_members(rows: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Add the members of an object, v_<name>, and their kinds, k_<name>, each computed once."""
    rows = rows.withColumns({f"v_{n}": member(F.col(value), n) for n in names})
    return rows.withColumns({f"k_{n}": kind(F.col(f"v_{n}")) for n in names})


def text(value: Column, k: Column) -> Column:
    """A string's own text; null for a value of any other kind."""
    return F.when(k == "string", F.try_variant_get(value, "$", "string"))


def shown(value: Column, k: Column) -> Column:
    """Any value as text: strings as they are, true and false as True and False, objects and arrays as JSON;
    empty for what is missing, null, zero, false or empty."""
    own = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    zero = (k == "number") & (own.try_cast("double") == 0)
    return F.when((own == "true") & (k == "boolean"), "True").when(k.isin("null", "boolean") | zero | own.isin("{}", "[]") & (k != "string"), "").otherwise(own)


def as_number(value: Column, k: Column) -> Column:
    """A number, a boolean (1 or 0), or a string that spells a number, as a double; null for any other value."""
    own = F.lower(F.regexp_replace(F.try_variant_get(value, "$", "string"), r"^\s+|\s+$", ""))
    plain = F.regexp_replace(F.regexp_replace(own, "_", ""), "^([+-]?)inf$", "$1infinity")
    spelt = F.when(own.rlike(f"^(?:{_NUMBER}|[+-]?(?:nan|inf|infinity))$"), F.regexp_replace(plain, "^[+-](?=nan)", "").try_cast("double"))
    return F.when(k == "string", spelt).when(k.isin("number", "boolean"), F.try_variant_get(value, "$", "double"))


def keys(raw: Column) -> Column:
    """Names of all members of all objects of a JSON text, at any depth; null if it cannot be read.

    Names that hold quotes, backslashes or control characters come without these.
    """
    whole = F.coalesce(F.to_json(parsed(raw)), F.when(F.json_object_keys(raw).isNotNull(), raw))
    plain = F.regexp_replace(whole, r"(?s)\\.", "")  # then a quote ends a string
    tokens = F.regexp_extract_all(plain, F.lit(r'"[^"]*"\s*:?'), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.regexp_extract(t, r'^"([^"]*)"', 1))
