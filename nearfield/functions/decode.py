"""Wire forms: raw float32 bytes, JSON arrays and numbers, URL parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; null where the length is no multiple of four."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def decode_vector(raw: Column, dim: int) -> Column:
    """As :func:`decode_f32`, but null unless the bytes are a vector of ``dim`` components."""
    return F.when(F.octet_length(raw) == 4 * dim, decode_f32(raw))


@F.pandas_udf(T.BinaryType())
def encode_f32(vector: pd.Series) -> pd.Series:
    """A vector as little-endian float32 bytes."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def json_vector(body: Column, key: str) -> Column:
    """The array of numbers after a key. Tokens that are no numbers are skipped; null if there is no array."""
    inner = F.regexp_extract(body, rf'(?s)"{key}"[^\[]*\[([^\]]*)\]', 1)
    tokens = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.regexp_like(body, F.lit(rf'(?s)"{key}"[^\[]*\[[^\]]*\]')), F.filter(tokens, lambda x: x.isNotNull()))


def json_vector_strict(body: Column, key: str) -> Column:
    """As :func:`json_vector`, but null if any token is no number."""
    inner = F.regexp_extract(body, rf'(?s)"{key}"[^\[]*\[([^\]]*)\]', 1)
    tokens = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.regexp_like(body, F.lit(rf'(?s)"{key}"[^\[]*\[[^\]]*\]')) & ~F.exists(tokens, lambda x: x.isNull()), tokens)


def json_bigint(body: Column, key: str, default: int | None = None) -> Column:
    """The integer after a key, or the default. The rest of the text need not be JSON."""
    found = F.regexp_extract(body, rf'"{key}"\s*:\s*(-?[0-9]+)', 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(default).cast("long"))


def url_param(url: Column, key: str) -> Column:
    """A query parameter's value; null if it is not there."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))
