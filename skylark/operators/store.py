"""Agents, conversations, messages and links as tables: merges, patches, listings and cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import all_of, page


def upsert_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def patch(base: DataFrame, changes: DataFrame, key: str, immutable: Sequence[str] = ("created_at",), now: Column | None = None, updated: str | None = None) -> DataFrame:
    """Non-null columns of ``changes`` replace those of ``base``; keys, immutable columns and rows without a change stay.
    Keys that are missing in ``base`` are an error."""
    lost = changes.join(base, key, "left_anti")
    if not lost.isEmpty():
        raise KeyError("rows to change are missing")
    p = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in changes.columns if c != key and c not in immutable])
    out = base.join(p, key, "left")
    new = {c: F.coalesce(f"_p_{c}", c) for c in base.columns if f"_p_{c}" in p.columns}
    if updated:
        new[updated] = F.when(F.col("_hit"), now).otherwise(F.col(updated))
    return out.withColumns(new).select(base.columns)


def list_agents(agents: DataFrame, kind: str | None = None, active: bool | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    tests = all_of(None if kind is None else F.col("type") == kind, None if active is None else F.col("active") == active)
    return page(agents.filter(tests), [F.desc("created_at"), "agent_id"], offset, limit)


def agent_conversations(agents: DataFrame, conversations: DataFrame, agent_id: int, limit: int) -> DataFrame:
    own = agents.filter(F.col("agent_id") == agent_id).select("agent_id")
    return conversations.join(own, "agent_id").orderBy(F.desc("updated_at"), "conv_id").limit(limit)


def conversation_messages(messages: DataFrame, conv_id: int, limit: int) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id).orderBy("ts", "turn").limit(limit)


def last_turns(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of every conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("ts"), F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """updated_at moves to the latest message."""
    last = messages.groupBy("conv_id").agg(F.max("ts").alias("_last"))
    return conversations.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("_last", "updated_at"))).drop("_last")


def delete_cascade(agents: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the agents in ``gone``, their conversations and messages."""
    convs = conversations.join(gone, "agent_id", "left_anti")
    dead = conversations.join(gone, "agent_id", "left_semi").select("conv_id")
    return agents.join(gone, "agent_id", "left_anti"), convs, messages.join(dead, "conv_id", "left_anti")


def agent_topics(links: DataFrame, limit: int, default: str = "RELATED_TO") -> DataFrame:
    """Links of each agent, one for each topic (the last written), newest first."""
    one = links.groupBy("agent_id", "topic").agg(F.max_by(F.coalesce("relationship", F.lit(default)), "ts").alias("relationship"), F.max("ts").alias("ts"))
    w = Window.partitionBy("agent_id").orderBy(F.desc("ts"), "topic")
    return one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def config_from_json(text: Column) -> Column:
    """A map of strings; bad JSON gives an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def partition_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``ids``, and the others."""
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")
