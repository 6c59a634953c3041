"""Classification and scoring of signals: one projection, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.dates import parse_time
from ..functions.text import has_any


def signal_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join("tags", " ")))


def classify(rules: R.Rules, text: str = "_text") -> Column:
    """Ordered rules, the first match wins."""
    kind, text = F.col("source_type"), F.col(text)
    return (
        F.when(has_any(text, rules.policy, True), R.POLICY)
        .when(kind.isin("research", "model") | has_any(text, rules.model, True), R.MODEL)
        .when(has_any(text, rules.enterprise, True), R.ENTERPRISE)
        .when((kind == "official") | has_any(text, rules.flagship, True), R.FLAGSHIP)
        .otherwise(R.PRODUCT)
    )


def heat() -> Column:
    top = F.greatest(F.lit(0.0), F.coalesce(F.array_max("heat_signals"), F.lit(0.0)).cast("double"))
    out = F.when(F.col("source_type") == "official", 24).when(F.col("source_type") == "research", 16)
    for kind, by in R.HEAT_DIVISORS.items():
        out = out.when(F.col("source_type") == kind, F.least(F.lit(30), F.floor(top / F.lit(float(by)) + 0.5)))
    return out.otherwise(0).cast("int")


def freshness(now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(parse_time(F.col("published_at")))) / F.lit(86400e6)
    return F.when(days.isNull(), 12).when(days <= 1, 20).when(days <= 2, 16).when(days <= 7, 10).otherwise(5)


def commercial(rules: R.Rules, text: str = "_text") -> Column:
    text = F.col(text)
    by_type = F.create_map(*[F.lit(x) for kv in {"official": 16, "product": 12, "community": 7}.items() for x in kv])[F.col("source_type")]
    category = F.when(F.col("category") == R.FLAGSHIP, 9).when(F.col("category") == R.ENTERPRISE, 7).when(F.col("category") == R.PRODUCT, 6).otherwise(0)
    total = F.lit(8) + F.coalesce(by_type, F.lit(0)) + category + F.when(has_any(text, rules.bonus, True), 7).otherwise(0) + F.when(has_any(text, rules.companies, True), 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(40), total)).cast("int")


def writability() -> Column:
    point = lambda test, n: F.when(test, n).otherwise(0)
    total = F.lit(4) + point(F.length("summary") >= 80, 2) + point(F.length("url") > 0, 1) + point(F.size("tags") > 0, 1) + point(F.col("category").isin(R.PRODUCT, R.FLAGSHIP), 2)
    return F.least(F.lit(10), total).cast("int")


def banded(score: Column, bands) -> Column:
    out = None
    for low, name in bands:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name) if low else out.otherwise(name)
    return out


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def evidence() -> Column:
    parts = F.array(
        F.concat(F.lit("来源："), F.col("source")),
        F.when(F.size("heat_signals") > 0, F.concat(F.lit("热度信号："), F.array_join(F.transform("heat_signals", _number), " / "))),
        F.when(F.length("published_at") > 0, F.concat(F.lit("发布时间："), F.substring("published_at", 1, 10))),
        F.when(F.size("tags") > 0, F.concat(F.lit("关键词："), F.array_join(F.slice("tags", 1, 5), ", "))),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def by_category(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("category")]


def recommended_topic() -> Column:
    title = F.trim("title")
    edited = F.when(title.rlike("[㐀-鿿]"), F.concat(title, F.lit("值得关注的三个信号"))).otherwise(F.concat(title, F.lit(" 为什么值得关注？")))
    return F.concat(edited, F.lit("（"), by_category(R.ANGLE_LABELS), F.lit("）"))


def score_signals(signals: DataFrame, now: Column, rules: R.Rules = R.Rules()) -> DataFrame:
    """Signals with category, the four part scores, score, action, angle, evidence, reason and recommended topic."""
    out = signals.withColumn("tags", F.filter("tags", lambda t: t.isNotNull() & (t != ""))).withColumn("_text", signal_text())
    out = out.withColumn("category", classify(rules))
    out = out.withColumns({"commercial_impact": commercial(rules), "heat": heat(), "freshness": freshness(now), "writability": writability()})
    out = out.withColumn("score", F.col("commercial_impact") + F.col("heat") + F.col("freshness") + F.col("writability"))
    out = out.withColumns({"action": banded(F.col("score"), R.ACTIONS), "angle": by_category(R.ANGLES), "evidence": evidence(), "recommended_topic": recommended_topic()})
    reason = F.concat(banded(F.col("score"), R.REASON_BANDS), F.lit("："), F.col("angle"), F.lit("，"), F.get("evidence", F.lit(0)), F.lit("。"))
    return out.withColumn("reason", reason).drop("_text")


def topic_radar(signals: DataFrame, now: Column, rules: R.Rules = R.Rules(), limit: int = 60, dedup_key: str | None = None) -> DataFrame:
    """The best ``limit`` of the scored signals; ties in order of collection. With ``dedup_key`` the best row of a key."""
    scored = score_signals(signals, now, rules)
    if dedup_key:
        w = Window.partitionBy(dedup_key).orderBy(F.desc("score"), "src_ord", "item_ord")
        scored = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return scored.orderBy(F.desc("score"), "src_ord", "item_ord").limit(limit)


def source_warnings(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, message) of expected sources whose rows are missing. expected: (source, group, message); sources of one
    group warn, once, only when all of them are empty."""
    joined = expected.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty = joined.groupBy("group").agg(F.sum("n").alias("n"), F.min("source").alias("source"), F.min("message").alias("message")).filter("n = 0")
    return empty.select("source", "message")
