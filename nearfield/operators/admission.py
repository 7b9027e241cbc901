"""Bearer tokens and token buckets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "Bearer "


def authenticate(requests: DataFrame, tokens: DataFrame, header: str = "authorization", enabled: bool = True) -> DataFrame:
    """requests with ``allowed``: the exact prefix, and a token of the table (token)."""
    if not enabled:
        return requests.withColumn("allowed", F.lit(True))
    known = tokens.select(F.col("token").alias("__token")).distinct().withColumn("__known", F.lit(True))
    token = F.when(F.col(header).startswith(PREFIX), F.substring(F.col(header), len(PREFIX) + 1, 1 << 20))
    return requests.withColumn("__t", token).join(known, F.col("__t") == F.col("__token"), "left").withColumn("allowed", F.coalesce("__known", F.lit(False))).drop("__t", "__token", "__known")


def add_tokens(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """The set of tokens (token) with new ones, each once."""
    return tokens.select("token").union(new.select("token")).where("token is not null").distinct()


def remove_tokens(tokens: DataFrame, gone: DataFrame) -> DataFrame:
    """The set of tokens without some; those that are not in it do nothing."""
    return tokens.select("token").join(gone.select("token"), "token", "left_anti").distinct()


def bucket_step(tokens: float | None, last: float, now: float, capacity: float, refill: float) -> tuple[float, bool]:
    """(tokens left, allowed). A client's first request fills its bucket; a rejected one empties it."""
    if tokens is None:
        return capacity - 1.0, True
    tokens = min(capacity, tokens + (now - last) * refill) - 1.0
    return (tokens, True) if tokens >= 0 else (0.0, False)


def token_bucket(requests: DataFrame, client: str, ts: str, order: str, capacity: float = 100.0, refill: float = 50.0) -> DataFrame:
    """client, order, allowed, tokens of each request, in the order of (ts, order) of each client.

    The state of a client after a request depends on all before it, so a client's requests stay together; they are
    folded row by row, as sorted runs, and never held at once.
    """

    def run(batches):
        state: dict = {}
        now_client = None
        for b in batches:
            out = []
            for c, o, t in zip(b["client"], b["ord"], b["t"], strict=True):
                if c != now_client:
                    now_client, state = c, {"tokens": None, "last": 0.0}
                left, ok = bucket_step(state["tokens"], state["last"], t, capacity, refill)
                state = {"tokens": left, "last": t}
                out.append((c, o, ok, left))
            yield pd.DataFrame(out, columns=["client", "ord", "allowed", "tokens"])

    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = requests.select(F.col(client).alias("client"), F.col(order).alias("ord"), t.alias("t")).repartition("client").sortWithinPartitions("client", "t", "ord")
    return rows.mapInPandas(run, "client long, ord long, allowed boolean, tokens double").select(F.col("client").alias(client), F.col("ord").alias(order), "allowed", "tokens")


def gate(allowed: Column, admitted: Column) -> Column:
    """What a request is told: authentication first, then the limiter."""
    return F.when(~allowed, "UNAUTHENTICATED").when(~admitted, "RESOURCE_EXHAUSTED").otherwise("OK")
