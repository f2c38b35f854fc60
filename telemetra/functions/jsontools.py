"""Canonical JSON hashes and inferred schemas, as small Arrow functions.

Spark's own JSON writer prints numbers and non-ASCII text differently, so byte-equal hashes need these.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _load(text: str):
    """A body that is not JSON is a plain string."""
    try:
        return json.loads(text)
    except ValueError:
        return text


_SCALARS = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string"}


def shape(value) -> dict:
    """Schema of one JSON value; differing array items are listed once each, in order of appearance."""
    if isinstance(value, dict):
        names = sorted(value)
        return {"type": "object", "required": names, "properties": {n: shape(value[n]) for n in names}}
    if isinstance(value, list):
        kinds = {canonical(s): s for s in map(shape, value)} or {"": {"type": "null"}}
        kinds = list(kinds.values())
        return {"type": "array", "items": kinds[0] if len(kinds) == 1 else {"anyOf": kinds}}
    return {"type": _SCALARS[type(value)]}


def _each_distinct(texts: pd.Series, fn) -> pd.Series:
    """Applies ``fn`` once per distinct text of the batch; nulls stay null, and so does a body nested too deeply."""

    def safe(text: str):
        try:
            return fn(text)
        except RecursionError:
            return None

    found = {t: safe(t) for t in texts.dropna().unique()}
    # as objects: a batch of nulls alone would become numbers, which are no strings to Arrow
    return pd.Series([found.get(t) for t in texts], index=texts.index, dtype=object)


@F.pandas_udf(T.StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    return _each_distinct(texts, lambda t: digest(_load(t)))


@F.pandas_udf(T.StringType())
def shape_hash(texts: pd.Series) -> pd.Series:
    return _each_distinct(texts, lambda t: digest(shape(_load(t))))


@F.pandas_udf(T.StringType())
def shape_json(texts: pd.Series) -> pd.Series:
    return _each_distinct(texts, lambda t: canonical(shape(_load(t))))


def dedup_key(text) -> Column:
    """JVM-side hash of key-sorted JSON: good for de-duplication, not byte-equal to ``canonical_hash``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.to_json(F.try_parse_json(c)), 256)
