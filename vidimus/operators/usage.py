"""Usage and cost (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES_WRITTEN = ("local", "remote")
MODES_READ = ("local", "self_host", "remote", "byok", "cloud")
CAPABILITIES = ("asr", "ocr", "embedding_text", "embedding_image", "video_understanding", "search_query")
STATUSES = ("ok", "success", "failed", "error", "cancelled")

# Prices in US dollars. One row a rule: capability, model, provider type, part of the base URL, unit, price, snapshot.
PRICES = [
    ("asr", "whisper-large-v3-turbo", None, "api.groq.com", "audio_hour", 0.04, "groq-whisper-large-v3-turbo-2026-05"),
    ("asr", "whisper-1", "openai", None, "audio_minute", 0.006, "openai-whisper-1-2026-05"),
    ("embedding_text", "gemini-embedding-2", None, None, "million_tokens", 0.20, "gemini-embedding-2-text-standard-2026-05"),
    ("embedding_image", "gemini-embedding-2", None, None, "image", 0.00012, "gemini-embedding-2-image-standard-2026-05"),
]


def measures() -> list[Column]:
    """The ten measures; sums of nothing are 0."""
    total = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return [
        F.count("*").alias("events"), total("request_count", "long"), total("input_tokens", "long"), total("output_tokens", "long"), total("audio_seconds", "double"), total("image_count", "long"),
        total("video_seconds", "double"), total("estimated_usd", "double"), total("billed_credits", "double"), F.count_if(F.col("estimated_usd").isNull()).alias("unpriced_events"),
    ]


def usage_totals(events: DataFrame) -> DataFrame:
    """H1: one row, also for no events."""
    return events.agg(*measures())


def usage_by_mode(events: DataFrame) -> DataFrame:
    """H2."""
    mode = F.when(F.col("provider_mode").isin("remote", "byok", "cloud"), "remote").when(F.col("provider_mode").isin("local", "self_host"), "local")
    return events.withColumn("mode", mode).where("mode is not null").groupBy("mode").agg(*measures())


def usage_by(events: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """H3: by item_id or job_id; events without the key are left out; only (key) restricts them."""
    rows = events.where(F.col(key).isNotNull())
    return (rows if only is None else rows.join(only.select(key).distinct(), key, "left_semi")).groupBy(key).agg(*measures())


def usage_by_capability(events: DataFrame) -> DataFrame:
    """H4."""
    return events.groupBy("capability").agg(*measures()).orderBy("capability")


def validate_usage(events: DataFrame, reading: bool = False) -> tuple[DataFrame, DataFrame]:
    """H5: (good, rejects) by the domains of mode, capability and status; reads know more modes than writes."""
    good = F.coalesce(F.col("provider_mode").isin(*(MODES_READ if reading else MODES_WRITTEN)) & F.col("capability").isin(*CAPABILITIES) & F.col("status").isin(*STATUSES), F.lit(False))
    return events.where(good), events.where(~good)


def estimate_cost(events: DataFrame) -> DataFrame:
    """H6: estimated_usd and price_snapshot_id from the price table, null for unknown models. events have base_url."""
    amount = {"audio_hour": F.col("audio_seconds") / 3600, "audio_minute": F.col("audio_seconds") / 60, "million_tokens": F.col("input_tokens") / 1_000_000, "image": F.col("image_count")}
    cost, snapshot = F.lit(None).cast("double"), F.lit(None).cast("string")
    for capability, model, provider, url, unit, price, name in reversed(PRICES):
        fits = (F.col("capability") == capability) & (F.col("model_id") == model)
        fits = fits if provider is None else fits & (F.col("provider_type") == provider)
        fits = fits if url is None else fits & F.col("base_url").contains(url)
        cost, snapshot = F.when(fits, amount[unit] * price).otherwise(cost), F.when(fits, name).otherwise(snapshot)
    return events.withColumn("estimated_usd", cost).withColumn("price_snapshot_id", snapshot)


def estimate_tokens(batches: DataFrame, keys: list[str]) -> DataFrame:
    """H7: a quarter of the characters, rounded up, but at least one a text."""
    return batches.groupBy(*keys).agg(F.greatest(F.ceil(F.sum(F.length("text")) / 4), F.count("*")).alias("tokens"))


def daily_usage(events: DataFrame) -> DataFrame:
    """H8's batch form: the measures by UTC day."""
    return events.groupBy(F.date_trunc("day", F.timestamp_seconds("created_at")).alias("day")).agg(*measures())


def recent_usage(events: DataFrame, limit: int = 50) -> DataFrame:
    """H9."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
