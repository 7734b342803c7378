"""The response cache as a table: namespace, key, value_json, stored_at, expires_at (null: never)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T

SCHEMA = "namespace string, key string, value_json string, stored_at timestamp, expires_at timestamp"


def key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in alphabetical order, without spaces; non-ASCII letters stay."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)


def store(cache: DataFrame, rows: DataFrame, ttl: int = 43200, now: Column | None = None) -> DataFrame:
    """``cache`` with ``rows`` (namespace, key, value_json) put in; the latest of a key stays."""
    at = F.current_timestamp() if now is None else now
    expires = F.timestamp_seconds(F.unix_timestamp(at) + ttl) if ttl > 0 else F.lit(None).cast("timestamp")
    new = rows.select("namespace", "key", "value_json", at.alias("stored_at"), expires.alias("expires_at"))
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("namespace", "key").orderBy(F.col("_new").desc(), F.col("stored_at").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def fetch(requests: DataFrame, cache: DataFrame, namespace: str, now: Column | None = None) -> DataFrame:
    """``requests`` (with ``key``) and what the cache holds: value_json, hit."""
    at = F.current_timestamp() if now is None else now
    live = cache.filter((F.col("namespace") == namespace) & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
    return requests.join(live.select("key", "value_json"), "key", "left").withColumn("hit", F.col("value_json").isNotNull())


def invalidate(cache: DataFrame, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, (namespace, removed) counts) without a namespace, or without any."""
    gone = cache if namespace is None else cache.filter(F.col("namespace") == namespace)
    return (cache.limit(0) if namespace is None else cache.filter(F.col("namespace") != namespace)), gone.groupBy("namespace").agg(F.count("*").alias("removed"))


def query_payload(question: Column, settings: Settings, index_version: Column, models: dict[str, str] | None = None) -> dict[str, Column]:
    """The fields that an answer depends on, for :func:`key`: the normalised question, the settings, the index' version and
    the models' names."""
    own = {f"setting_{f.name}": F.lit(getattr(settings, f.name)) for f in dataclasses.fields(settings)}
    return own | {f"model_{k}": F.lit(v) for k, v in (models or {}).items()} | {"question": T.cache_form(F.coalesce(question, F.lit(""))), "index_version": index_version.cast("string")}


def agent_payload(question: Column, messages: Column, settings: Settings, index_version: Column, agent_version: str = "1", models: dict[str, str] | None = None) -> dict[str, Column]:
    """:func:`query_payload` and the normalised messages (array<struct<role, text>>) and the agent's version."""
    role = lambda m: F.coalesce(F.nullif(F.lower(F.trim(m["role"])), F.lit("")), F.lit("user"))
    said = F.transform(messages, lambda m: F.struct(role(m).alias("role"), T.cache_form(F.coalesce(m["text"], F.lit(""))).alias("content")))
    return query_payload(question, settings, index_version, models) | {"messages": said, "agent_version": F.lit(agent_version)}


def cacheable(answers: DataFrame) -> DataFrame:
    """Answers that may be stored: neither asked for with ``debug`` nor with an ``error``."""
    return answers.filter(~F.coalesce("debug", F.lit(False)) & F.col("error").isNull())
