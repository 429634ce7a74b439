"""Lax reading of one member of a model's JSON answer.

A member is judged by the type it has in the parsed VARIANT (``kind``); its reading is NULL if it cannot be coerced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts accepted as booleans, in any case.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

_WHOLE_TEXT = r"(?U)^\s*[+-]?[0-9]+(_[0-9]+)*(\.0*)?\s*\z"
_REAL_TEXT = (
    r"(?iU)^\s*[+-]?((([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity|nan)\s*\z"
)


def members(document: Column, names: list[str]) -> Column:
    """The named members as a struct of variants, found in one pass; NULL if the document is no object."""
    return F.try_variant_get(document, "$", f"struct<{', '.join(f'`{n}`: variant' for n in names)}>")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _as(value: Column, type_name: str) -> Column:
    return F.try_variant_get(value, "$", type_name)


def _compact(value: Column) -> Column:
    """Text without blanks and digit-group underscores."""
    return F.regexp_replace(_as(value, "string"), r"(?U)[\s_]", "")


def text(value: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", _as(value, "string"))


def flag(value: Column, kind: Column) -> Column:
    number, word = _as(value, "double"), F.lower(_as(value, "string"))
    return (
        F.when(kind == "BOOLEAN", _as(value, "boolean"))
        .when(_is_number(kind) & number.isin(0.0, 1.0), number == 1.0)
        .when((kind == "STRING") & word.isin(*TRUE_WORDS), True)
        .when((kind == "STRING") & word.isin(*FALSE_WORDS), False)
    )


def whole(value: Column, kind: Column) -> Column:
    number = _as(value, "double")
    return (
        F.when(kind == "BIGINT", _as(value, "bigint"))
        .when(kind == "BOOLEAN", _as(value, "boolean").cast("bigint"))
        .when(_is_number(kind) & (number == F.floor(number)), _as(value, "bigint"))
        .when(
            (kind == "STRING") & _as(value, "string").rlike(_WHOLE_TEXT),
            F.regexp_replace(_compact(value), r"\.0*\z", "").try_cast("bigint"),
        )
    )


def real(value: Column, kind: Column) -> Column:
    return (
        F.when(kind == "BIGINT", _as(value, "bigint").cast("double"))
        .when(kind == "BOOLEAN", _as(value, "boolean").cast("double"))
        .when(_is_number(kind), _as(value, "double"))
        .when((kind == "STRING") & _as(value, "string").rlike(_REAL_TEXT), _compact(value).try_cast("double"))
    )


READERS = {T.StringType(): text, T.BooleanType(): flag, T.LongType(): whole, T.DoubleType(): real}


def record_json(record: Column) -> Column:
    """A record as JSON text with every key present; other scripts are kept as they are."""
    return F.to_json(record, {"ignoreNullFields": "false"})
