"""Topic graph tables rebuilt from facts, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_id() -> Column:
    return F.lower(F.trim("title")).alias("topic_id")


def topics(app: DataFrame) -> DataFrame:
    """One node a topic: last written name and category, best score, number of rows, first and last date."""
    return app.groupBy(topic_id()).agg(
        F.max_by(F.trim("title"), "ord").alias("name"), F.max_by("category", "ord").alias("category"), F.max("score").alias("total_score"),
        F.count("*").alias("mention_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
    )


def appeared_on(app: DataFrame) -> DataFrame:
    """One edge a topic and day, with the properties written last."""
    last = F.max_by(F.struct("score", "action"), "ord")
    return app.groupBy(topic_id(), "date").agg(last.alias("p")).select("topic_id", "date", "p.score", "p.action")


def sources(app: DataFrame) -> DataFrame:
    return app.select(F.trim("source").alias("source")).filter("source <> ''").distinct()


def mentions(app: DataFrame, least: int = 2) -> DataFrame:
    """Distinct (entity_id, topic_id) of tags of ``least`` characters or more."""
    tag = F.trim("tag")
    rows = app.select(topic_id(), "ord", F.explode("tags").alias("tag")).filter(F.length(tag) >= least)
    return rows.select(F.lower(tag).alias("entity_id"), "topic_id").distinct()


def entities(app: DataFrame, kind: Column, least: int = 2) -> DataFrame:
    """(entity_id, name, kind) of the tags; ``kind`` is an expression over the column name."""
    tag = F.trim("tag")
    rows = app.select("ord", F.explode("tags").alias("tag")).filter(F.length(tag) >= least)
    return rows.groupBy(F.lower(tag).alias("entity_id")).agg(F.max_by(tag, "ord").alias("name")).withColumn("kind", kind)


def discovered_via(app: DataFrame) -> DataFrame:
    return app.select(topic_id(), F.trim("source").alias("source")).filter("source <> ''").distinct()


def days(app: DataFrame, dates: DataFrame) -> DataFrame:
    """Candidates of each day, days without any included."""
    counts = app.groupBy("date").agg(F.count("*").alias("n"))
    return dates.select("date").distinct().join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


def documents(reports: DataFrame, limit: int = 50_000) -> DataFrame:
    """Document nodes with their PART_OF day."""
    return reports.select(F.concat_ws("/", "date", "report_type").alias("document_id"), "date", "report_type", F.substring("content", 1, limit).alias("content"))


def trend(app: DataFrame, contains: str, since: Column) -> DataFrame:
    """Appearances of matching topics since a day, with the direction of each topic."""
    edges = appeared_on(app).filter(F.contains("topic_id", F.lit(contains.lower())) & (F.col("date").cast("date") >= since))
    w = Window.partitionBy("topic_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    delta = F.last("score").over(w) - F.first("score").over(w)
    direction = F.when(delta > 0, "up").when(F.count("*").over(w) > 1, "flat").otherwise("new")
    return edges.select("topic_id", "date", "score", direction.alias("direction"), delta.alias("delta"))


def write_edges(edges: DataFrame, name: str, path: str, key: str = "topic_id", buckets: int = 64) -> None:
    """A table of edges in buckets of ``key``, sorted by it: joins of such tables on the key need no shuffle, so only
    tables of equal ``buckets`` should meet. The table is known by ``name`` to the session's catalogue."""
    edges.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)


def entity_info(app: DataFrame, contains: str, limit: int = 5) -> DataFrame:
    return entity_neighbours(mentions(app), contains, limit)


def entity_neighbours(m: DataFrame, contains: str, limit: int = 5) -> DataFrame:
    """Topics of matching entities and the entities that share them, first ``limit`` of each by name; m: distinct
    (entity_id, topic_id), best a table of ``write_edges``."""
    own = m.filter(F.contains("entity_id", F.lit(contains.lower())))
    other = m.withColumnRenamed("entity_id", "other_id")
    related = own.join(other, "topic_id").filter(F.col("other_id") != F.col("entity_id"))

    def first(rows: DataFrame, column: str, name: str) -> DataFrame:
        """The first names of each entity: few rows reach the aggregate, however many it has."""
        rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(column))
        few = rows.select("entity_id", column).filter(F.col(column).isNotNull()).distinct().withColumn("_n", rank).filter(F.col("_n") <= limit)
        return few.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))

    out = first(own, "topic_id", "topics").join(first(related, "other_id", "related"), "entity_id", "left")
    return out.select("entity_id", "topics", F.coalesce("related", F.lit("")).alias("related"))


def daily_overview(app: DataFrame, date: str, limit: int = 10) -> DataFrame:
    """The best topics of a day by that day's score."""
    import re

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError("date must be YYYY-MM-DD")
    day = appeared_on(app).filter(F.col("date") == date)
    return day.join(topics(app).select("topic_id", "name", "category"), "topic_id").orderBy(F.desc("score"), "topic_id").limit(limit)


def recommend(app: DataFrame, today: Column, category: str = "", days_back: int = 14, limit: int = 5) -> DataFrame:
    """Recent topics by 0.7 * score + 0.3 * 3 * mentions."""
    t = topics(app).filter((F.col("last_seen").cast("date") >= F.date_sub(today, days_back)) & (F.col("mention_count") > 0) & F.contains("category", F.lit(category)))
    weighted = F.round(F.col("total_score") * 0.7 + F.col("mention_count") * 3 * 0.3, 6)
    return t.select("topic_id", "category", "total_score", "mention_count", weighted.alias("weighted")).orderBy(F.desc("weighted"), "topic_id").limit(limit)


def source_coverage(app: DataFrame, contains: str) -> DataFrame:
    """Sources of matching topics, with their score."""
    t = topics(app).filter(F.contains("topic_id", F.lit(contains.lower())))
    joined = t.join(discovered_via(app), "topic_id", "left")
    return joined.groupBy("topic_id", "total_score").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
