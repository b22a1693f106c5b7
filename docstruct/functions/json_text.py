"""JSON texts that built-in parsers refuse although readers of such answers take them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _rewritten(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=_refuse), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore").astype(object)


def last_values(text: Column, movable: bool = True) -> Column:
    """*text* where it is JSON, with the last value of keys that an object repeats; else null.

    Texts without repeated keys stay as they are and never leave the JVM: only what the built-in
    parser refuses is read a second time. Not *movable*, it is computed where it is written: a filter on it
    is not pushed below a shuffle, to tasks that may be few.
    """
    good = F.try_parse_json(text).isNotNull()
    rewritten = F.pandas_udf(_rewritten, "string")
    return F.when(good, text).otherwise((rewritten if movable else rewritten.asNondeterministic())(F.when(~good, text)))
