"""JSON as values: canonical text for equality, and setting a field."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _plain(value):
    """Numbers that are equal get one text; members are sorted when dumped."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, Decimal):
        return _Number(format(value.normalize() if value else Decimal(0), "f"))
    return value


class _Number(float):
    """A number that is dumped as its exact text."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def canonical(text: str | None) -> str | None:
    """One text for all JSON texts of a value: order of members, spelling of numbers and spaces don't matter.

    Of a repeated member the last counts. Null stays null; what isn't JSON gives null.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=lambda _: None)
    except ValueError:
        return None
    return _dump(_plain(value))


def _dump(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return value.text if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def set_field(text: str | None, field: str, value: str) -> str | None:
    """The JSON object with a member set to a JSON value; null where the text is no object."""
    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return json.dumps({**found, field: json.loads(value)}, separators=(",", ":"), ensure_ascii=False) if isinstance(found, dict) else None


#: A string of a JSON text, or a number written as a double without fraction.
_WHOLE = r'("(?:[^"\\]|\\.)*+")|(?<![\d.])(-?\d+)\.0(?![\dE])'


def canonical_json(text: Column | str) -> Column:
    """One text for all JSON texts of a value, by Spark's own functions: variants have their members in order and decimals without trailing zeros.

    Numbers with an exponent are doubles, equal to a plain number where they are short (1e2 is 100, but 1e7 isn't 10000000); digits beyond 38 are lost.
    Of a text whose objects have a member twice only white space is normalised. What isn't JSON is null.
    """
    text = F.col(text) if isinstance(text, str) else text
    value = F.to_json(F.try_parse_json(text))
    plain = F.when(F.contains(value, F.lit(".0")), F.regexp_replace(value, _WHOLE, "$1$2")).otherwise(value)
    return F.coalesce(F.when(plain == "-0", "0").otherwise(plain), F.get_json_object(text, "$"))


@pandas_udf(StringType())
def json_with(texts: pd.Series, fields: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([set_field(t, f, v) for t, f, v in zip(texts, fields, values)], dtype="object")
