"""The driver's tables as the engine's own tables, in Spark and (for the oracle) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .registry import table

NOW_TEXT = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def signals(spark: SparkSession, sf: str, read=table) -> DataFrame:
    d = read(spark, sf, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("github", "community", "product", "research", "model", "official")]), (F.col("doc_id") % 6 + 1).cast("int"))
    age = F.make_interval(hours=((F.col("doc_id") * 5) % 240).cast("int"))
    return d.select(
        F.substring("text", 1, 60).alias("title"), F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source", kind.alias("source_type"), F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 7 != 0, F.date_format(now() - age, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
        F.when((F.col("doc_id") % 6).isin(3, 5), F.array().cast("array<double>")).otherwise(F.array(F.col("n_chars").cast("double"), ((F.col("doc_id") * 37) % 1000).cast("double"))).alias("heat_signals"),
        F.array("lang", "source").alias("tags"), (F.col("doc_id") % 6).cast("int").alias("src_ord"), F.col("doc_id").alias("item_ord"),
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    base = d.select("doc_id", day.alias("date"), F.when(F.col("doc_id") % 50 == 0, "ai-weekly").otherwise(F.concat(F.lit("ai-"), "source")).alias("report_type"), F.col("text").alias("content"))
    return base


def appearances(spark: SparkSession, sf: str, read=table) -> DataFrame:
    e = read(spark, sf, "events")
    score = F.least(F.lit(100), F.floor(F.col("value") / 5.0)).cast("int")
    action = F.when(score >= 80, "深挖").when(score >= 65, "入池").when(score >= 50, "观察").otherwise("归档")
    topic = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    return e.select(
        topic.alias("title"), F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd").alias("date"), score.alias("score"), action.alias("action"),
        F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("source"),
        F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string"))).alias("tags"), F.struct("ts", "event_id").alias("ord"), "ts", "event_id",
    )


def repo_items(spark: SparkSession, sf: str) -> DataFrame:
    o, c, li = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    lines = li.groupBy(F.col("l_orderkey").alias("number")).agg(F.count("*").alias("comments"))
    items = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.col("c_name").alias("login"),
        F.col("c_mktsegment").alias("repo"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 3 == 0).alias("is_pr"), F.col("o_orderpriority").alias("title"),
    )
    n = F.col("number")
    name = lambda x: F.named_struct(F.lit("name"), x)
    some = F.array(name(F.concat(F.lit("p"), (n % 5).cast("string"))), name(F.lit("size")))
    kind = F.when(F.col("is_pr"), "/pull/").otherwise("/issues/")
    return items.join(lines, "number", "left").select(
        *items.columns, F.coalesce("comments", F.lit(0)).alias("comments"), F.named_struct(F.lit("login"), F.col("login")).alias("user"), F.when(n % 4 != 0, some).alias("labels"),
        F.date_add(F.col("created_at").cast("date"), (n % 40).cast("int")).alias("updated_at"), F.when(n % 9 != 0, F.named_struct(F.lit("+1"), (n % 9).cast("int"))).alias("reactions"),
        F.when(n % 5 != 0, F.repeat(F.concat(F.lit(" line "), n.cast("string"), F.lit("\n")), (n % 60).cast("int"))).alias("body"),
        F.concat(F.lit("https://github.com/org/"), F.col("repo"), kind, n.cast("string")).alias("html_url"), F.when(F.col("is_pr"), "pull").alias("pull_request"), F.col("is_pr").alias("is_pull"),
    )


def agents(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("agent_id")).distinct()
    return ids.select("agent_id", F.concat(F.lit("t"), (F.col("agent_id") % 3).cast("string")).alias("type"), (F.col("agent_id") % 2 == 0).alias("active"), F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("agent_id").cast("int"), F.lit(0), F.lit(0)).alias("created_at"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    start = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"))
    return c.select("conv_id", (F.col("conv_id") % 10).alias("agent_id"), start.alias("created_at"), start.alias("updated_at"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
    return c.select("conv_id", "turn", "role", "text", ts.alias("ts"), F.length("text").alias("token_count"))


def sitemap(spark: SparkSession, sf: str, read=table) -> DataFrame:
    p = read(spark, sf, "pages")
    day = lambda back: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int") - F.when(F.lit(back) & (F.col("page_id") % 4 == 0), 1).otherwise(0)), "yyyy-MM-dd")
    return p.select("page_id", F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")).alias("site"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 11 != 0, day(False)).alias("lastmod"), F.coalesce(F.when(F.col("page_id") % 11 != 0, day(True)), F.lit("seen")).alias("was"))


def crawl_state(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap(spark, sf).filter("page_id % 2 = 0 AND page_id % 3 <> 2").select("site", "url", F.col("was").alias("lastmod"))


def _any(words, text="t"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_C = R.CORPUS_RULES
SIGNALS_SQL = f"""v_signals AS (
  SELECT left(text, 60) AS title, 'https://example.org/' || source || '/' || doc_id AS url, source,
    (['github', 'community', 'product', 'research', 'model', 'official'])[(doc_id % 6 + 1)::INT] AS source_type, text AS summary,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(TIMESTAMP '{NOW_TEXT}' - to_hours(((doc_id * 5) % 240)::INT), '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
    CASE WHEN doc_id % 6 IN (3, 5) THEN []::BIGINT[] ELSE [n_chars, (doc_id * 37) % 1000] END AS heat_signals,
    [lang, source] AS tags, (doc_id % 6)::INT AS src_ord, doc_id AS item_ord FROM documents
), v_text AS (SELECT *, lower(title || ' ' || summary || ' ' || array_to_string(tags, ' ')) AS t FROM v_signals),
v_class AS (SELECT *, CASE WHEN {_any(_C.policy)} THEN '{R.POLICY}'
  WHEN source_type IN ('research', 'model') OR {_any(_C.model)} THEN '{R.MODEL}'
  WHEN {_any(_C.enterprise)} THEN '{R.ENTERPRISE}' WHEN source_type = 'official' OR {_any(_C.flagship)} THEN '{R.FLAGSHIP}' ELSE '{R.PRODUCT}' END AS category FROM v_text),
v_parts AS (SELECT *,
  least(40, 8 + CASE source_type WHEN 'official' THEN 16 WHEN 'product' THEN 12 WHEN 'community' THEN 7 ELSE 0 END
    + CASE category WHEN '{R.FLAGSHIP}' THEN 9 WHEN '{R.ENTERPRISE}' THEN 7 WHEN '{R.PRODUCT}' THEN 6 ELSE 0 END
    + CASE WHEN {_any(_C.bonus)} THEN 7 ELSE 0 END + CASE WHEN {_any(_C.companies)} THEN 5 ELSE 0 END)::INT AS commercial_impact,
  (CASE source_type WHEN 'official' THEN 24 WHEN 'research' THEN 16 ELSE least(30, floor(greatest(0, list_max(heat_signals))
    / (CASE source_type WHEN 'product' THEN 8.0 WHEN 'community' THEN 12.0 WHEN 'github' THEN 15.0 ELSE 20.0 END)::DOUBLE + 0.5)) END)::INT AS heat,
  (CASE WHEN published_at IS NULL THEN 12 WHEN (item_ord * 5) % 240 <= 24 THEN 20 WHEN (item_ord * 5) % 240 <= 48 THEN 16 WHEN (item_ord * 5) % 240 <= 168 THEN 10 ELSE 5 END)::INT AS freshness,
  least(10, 4 + CASE WHEN len(summary) >= 80 THEN 2 ELSE 0 END + 1 + 1 + CASE WHEN category IN ('{R.PRODUCT}', '{R.FLAGSHIP}') THEN 2 ELSE 0 END)::INT AS writability FROM v_class),
v_scored AS (SELECT *, commercial_impact + heat + freshness + writability AS score,
  CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ANGLES.items())} END AS angle,
  list_filter(['来源：' || source, CASE WHEN len(heat_signals) > 0 THEN '热度信号：' || array_to_string(heat_signals, ' / ') END,
    CASE WHEN published_at IS NOT NULL THEN '发布时间：' || left(published_at, 10) END, '关键词：' || array_to_string(tags, ', ')], lambda x: x IS NOT NULL) AS evidence,
  CASE WHEN regexp_matches(trim(title), '[\\x{{3400}}-\\x{{9fff}}]') THEN trim(title) || '值得关注的三个信号' ELSE trim(title) || ' 为什么值得关注？' END
    || '（' || CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ANGLE_LABELS.items())} END || '）' AS recommended_topic FROM v_parts),
v_pool AS (SELECT *, CASE WHEN score >= 80 THEN '深挖' WHEN score >= 65 THEN '入池' WHEN score >= 50 THEN '观察' ELSE '归档' END AS action,
  CASE WHEN score >= 80 THEN '值得优先深挖' WHEN score >= 65 THEN '适合进入今日选题池' ELSE '适合作为观察项' END || '：' || angle || '，' || evidence[1] || '。' AS reason FROM v_scored)"""
REPORTS_SQL = """v_reports AS (SELECT doc_id, strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS date,
  CASE WHEN doc_id % 50 = 0 THEN 'ai-weekly' ELSE 'ai-' || source END AS report_type, text AS content FROM documents)"""
APPEARANCES_SQL = """v_app AS (SELECT *, CASE WHEN score >= 80 THEN '深挖' WHEN score >= 65 THEN '入池' WHEN score >= 50 THEN '观察' ELSE '归档' END AS action FROM (
  SELECT event_type || '-' || user_id AS title, event_type AS category, strftime(ts, '%Y-%m-%d') AS date, least(100, floor(value / 5.0))::INT AS score,
    's' || (event_id % 8) AS source, [event_type, 'u' || (user_id % 30)] AS tags, {'ts': ts, 'e': event_id} AS ord, ts, event_id FROM events))"""
REPO_SQL = """v_items AS (SELECT *, CASE WHEN number % 4 <> 0 THEN ' [p' || (number % 5) || ', size]' ELSE '' END AS labels, created_at::DATE + (number % 40)::INT AS updated_at, number % 9 AS thumbs,
  CASE WHEN number % 5 <> 0 THEN repeat(' line ' || number || chr(10), number % 60) ELSE '' END AS body FROM (SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state, c_name AS login, c_mktsegment AS repo,
  o_orderdate AS created_at, o_orderkey % 3 = 0 AS is_pr, o_orderpriority AS title, coalesce(n, 0) AS comments
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""
STORE_SQL = """v_agents AS (SELECT DISTINCT conv_id % 10 AS agent_id, 't' || (conv_id % 10 % 3) AS type, conv_id % 10 % 2 = 0 AS active, TIMESTAMP '2024-01-01' + to_hours((conv_id % 10)::INT) AS created_at FROM conversations),
v_conv AS (SELECT DISTINCT conv_id, conv_id % 10 AS agent_id, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) AS created_at, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) AS updated_at FROM conversations),
v_msg AS (SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts, len(text)::INT AS token_count FROM conversations)"""
SITEMAP_SQL = """v_site AS (SELECT page_id, 'site' || (page_id % 3) AS site, url || '#' || page_id AS url,
  CASE WHEN page_id % 11 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%Y-%m-%d') END AS lastmod,
  coalesce(CASE WHEN page_id % 11 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 28)::INT - CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') END, 'seen') AS was FROM pages),
v_state AS (SELECT site, url, was AS lastmod FROM v_site WHERE page_id % 2 = 0 AND page_id % 3 <> 2)"""
