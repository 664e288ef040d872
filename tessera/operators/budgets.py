"""Texts and choices within budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import jaccard


def head_and_tail(x: Column, limit: int, marker: str = "\n[...]\n") -> Column:
    """A longer text as its first 75 % and last 25 % of what the limit leaves beside the marker."""
    room = max(limit - len(marker), 0)
    head = room * 3 // 4
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.left(x, F.lit(head)), F.lit(marker), F.right(x, F.lit(room - head))))


@F.pandas_udf(StringType())
def token_prefix(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    """The longest prefix within a token budget (1 an ideograph, 1.35 a word, 0.25 another mark), with an ellipsis if cut."""
    import math
    import re

    weigh = re.compile(r"[㐀-鿿]|[A-Za-z0-9]+|[^\sA-Za-z0-9㐀-鿿]")

    def cut(text, budget):
        if not text:
            return text
        used, end = 0.0, 0
        for m in weigh.finditer(text):
            t = m.group()
            used += 1 if "㐀" <= t <= "鿿" else 1.35 if t[0].isascii() and t[0].isalnum() else 0.25
            if math.ceil(used) > budget:
                return text[: max(end, 1)].rstrip() + "…"
            end = m.end()
        return text

    return pd.Series([cut(t, b) for t, b in zip(texts, budgets)])


def fitted_shares(rows: DataFrame, by: str, key: str, size: str, budget: int, least: int = 64) -> DataFrame:
    """(by, key, share): shortest first, each gets its size or an equal part of what is left, ``least`` at least.

    An ordered fold over a group that its caller bounds.
    """
    packed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(size).cast("bigint").alias("size"), F.col(key).alias("key")))).alias("rows"))
    kind = f"array<struct<key:{dict(rows.dtypes)[key]},share:bigint>>"
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.size("rows").cast("bigint").alias("n"), F.array().cast(kind).alias("out"))

    def step(s, r):
        share = F.least(r["size"], F.greatest(F.lit(least).cast("bigint"), F.floor(s["left"] / s["n"])))
        return F.struct(F.greatest(s["left"] - share, F.lit(0).cast("bigint")).alias("left"), (s["n"] - 1).alias("n"), F.concat(s["out"], F.array(F.struct(r["key"].alias("key"), share.alias("share")))).alias("out"))

    out = packed.select(by, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r"))
    return out.select(by, F.col("r.key").alias(key), F.col("r.share").alias("share"))


def diverse_actions(actions: DataFrame, by: str, budget: int, external: int, alike: float = 0.85) -> DataFrame:
    """(by, action, reason) of actions(action, score, terms, is_external): greedy by score within two budgets, none too like a chosen one."""
    packed = actions.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "action", "terms", "is_external"))).alias("rows"))
    item = "struct<action:string,terms:array<string>,is_external:boolean,reason:string>"

    def step(out, r):
        chosen = F.filter(out, lambda x: x["reason"] == "chosen")
        reason = (
            F.when(F.size(chosen) >= budget, "action budget")
            .when(r["is_external"] & (F.size(F.filter(chosen, lambda x: x["is_external"])) >= external), "external budget")
            .when(F.exists(chosen, lambda x: jaccard(x["terms"], r["terms"]) >= alike), "too similar")
            .otherwise("chosen")
        )
        return F.concat(out, F.array(F.struct(r["action"].alias("action"), r["terms"].alias("terms"), r["is_external"].alias("is_external"), reason.alias("reason")).cast(item)))

    done = packed.select(by, F.explode(F.aggregate("rows", F.array().cast(f"array<{item}>"), step)).alias("r"))
    return done.select(by, F.col("r.action").alias("action"), F.col("r.reason").alias("reason"))
