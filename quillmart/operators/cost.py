"""Token and cost arithmetic, in integer micro-units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with the price of their model, else of the provider's default model, else none."""
    cols = ["in_per_m", "out_per_m", "cached_per_m"]
    exact = prices.select("provider", "model", *[F.col(c).alias(f"_{c}") for c in cols])
    default = prices.where("model = 'default'").select("provider", *[F.col(c).alias(f"d_{c}") for c in cols])
    joined = runs.join(exact, ["provider", "model"], "left").join(default, "provider", "left")
    return joined.select(*runs.columns, *[F.coalesce(f"_{c}", f"d_{c}").alias(c) for c in cols])


def cost_nano(token_in: Column, token_out: Column, cached: Column, batch: Column) -> Column:
    """Billionths: cached tokens come on top of all input tokens; a batch costs half. Prices are milli-units a million."""
    full = token_in * F.col("in_per_m") + token_out * F.col("out_per_m") + cached * F.col("cached_per_m")
    return F.when(batch, F.floor(full / 2)).otherwise(full).cast("long")


def resolved_tokens(actual: Column, text: Column, chars: Column) -> tuple[Column, Column]:
    """Tokens from the first that is known of actual, text, length; and which one it was."""
    rough = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / 5)).cast("long")
    tokens = F.coalesce(F.when(actual > 0, actual), F.when(F.char_length(text) > 0, rough(F.char_length(text))), F.when(chars > 0, rough(chars)), F.lit(0)).cast("long")
    quality = F.when(actual > 0, "actual").when(F.char_length(text) > 0, "text").when(chars > 0, "rough").otherwise("none")
    return tokens, quality
