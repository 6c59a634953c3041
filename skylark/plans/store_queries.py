"""Queries of the graph, catalogue, crawl, conversation store, retrieval, assembly and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..operators import assembly, catalog, contexts, crawl, fulltext, graph, retrieval, store, vector_index
from ..sources import landed, sinks
from ..streaming import streams, tables
from . import views as V
from .registry import query, scratch, stored, table

_A, _R, _I, _T, _M = (f"WITH {s} " for s in (V.APPEARANCES_SQL, V.REPORTS_SQL, V.REPO_SQL, V.STORE_SQL, V.SITEMAP_SQL))
RULES = R.CORPUS_RULES

# graph -----------------------------------------------------------------------------------------------------------
_TOPICS = """(SELECT lower(trim(title)) AS topic_id, arg_max(trim(title), ord) AS name, arg_max(category, ord) AS category, max(score) AS total_score, count(*) AS mention_count,
  min(date) AS first_seen, max(date) AS last_seen FROM v_app GROUP BY 1)"""
_EDGES = "(SELECT lower(trim(title)) AS topic_id, date, arg_max(score, ord) AS score, arg_max(action, ord) AS action FROM v_app GROUP BY ALL)"
_MENTIONS = "(SELECT DISTINCT lower(tag) AS entity_id, topic_id FROM (SELECT lower(trim(title)) AS topic_id, unnest(tags) AS tag FROM v_app) WHERE len(tag) >= 2)"
_VIA = "(SELECT DISTINCT lower(trim(title)) AS topic_id, source FROM v_app)"


@query("kg_topics", _A + f"SELECT * FROM {_TOPICS}")
def kg_topics(spark, sf):
    return graph.topics(V.appearances(spark, sf))


@query("kg_appeared_on", _A + f"SELECT * FROM {_EDGES}")
def kg_appeared_on(spark, sf):
    return graph.appeared_on(V.appearances(spark, sf))


@query("kg_sources", _A + "SELECT DISTINCT source FROM v_app")
def kg_sources(spark, sf):
    return graph.sources(V.appearances(spark, sf))


@query("kg_mentions", _A + f"SELECT * FROM {_MENTIONS}")
def kg_mentions(spark, sf):
    return graph.mentions(V.appearances(spark, sf))


@query("kg_entities", _A + "SELECT lower(tag) AS entity_id, arg_max(tag, ord) AS name, CASE WHEN lower(tag) IN ('click') THEN 'company' WHEN contains(lower(tag), 'ie') THEN 'technology' WHEN contains(lower(tag), 'u1') THEN 'project' ELSE 'topic_tag' END AS kind FROM (SELECT ord, unnest(tags) AS tag FROM v_app) WHERE len(tag) >= 2 GROUP BY 1, 3")
def kg_entities(spark, sf):
    return graph.entities(V.appearances(spark, sf), X.entity_type(F.col("name"), ("click",), ("ie",), ("u1",)))


@query("kg_discovered_via", _A + f"SELECT * FROM {_VIA}")
def kg_discovered_via(spark, sf):
    return graph.discovered_via(V.appearances(spark, sf))


@query("kg_days", _A + "SELECT d.date, count(v_app.title) AS n FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events UNION SELECT '2024-03-01') d LEFT JOIN v_app ON v_app.date = d.date GROUP BY d.date")
def kg_days(spark, sf):
    a = V.appearances(spark, sf)
    return graph.days(a, a.select("date").unionByName(spark.range(1).select(F.lit("2024-03-01").alias("date"))))


@query("kg_documents", _R + "SELECT date || '/' || report_type AS document_id, date, report_type, md5(left(content, 50000)) AS content_md5 FROM v_reports")
def kg_documents(spark, sf):
    return graph.documents(V.reports(spark, sf)).select("document_id", "date", "report_type", F.md5("content").alias("content_md5"))


@query("topic_trend", _A + f"""SELECT topic_id, date, score, CASE WHEN delta > 0 THEN 'up' WHEN n > 1 THEN 'flat' ELSE 'new' END AS direction, delta FROM (
  SELECT topic_id, date, score, last_value(score) OVER w - first_value(score) OVER w AS delta, count(*) OVER w AS n FROM {_EDGES} WHERE contains(topic_id, 'click') AND date::DATE >= DATE '2024-01-20'
  WINDOW w AS (PARTITION BY topic_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def topic_trend(spark, sf):
    return graph.trend(V.appearances(spark, sf), "click", F.lit("2024-01-20").cast("date"))


@query("entity_info", _A + f""", m AS {_MENTIONS}, own AS (SELECT * FROM m WHERE contains(entity_id, 'u1')),
t AS (SELECT entity_id, array_to_string(list_sort(list(DISTINCT topic_id))[1:5], ',') AS topics FROM own GROUP BY 1),
r AS (SELECT o.entity_id, array_to_string(list_sort(list(DISTINCT b.entity_id))[1:5], ',') AS related FROM own o JOIN m b ON o.topic_id = b.topic_id AND o.entity_id <> b.entity_id GROUP BY 1)
SELECT t.entity_id, topics, coalesce(related, '') AS related FROM t LEFT JOIN r ON t.entity_id = r.entity_id""")
def entity_info(spark, sf):
    def build(path):
        graph.write_edges(graph.mentions(V.appearances(spark, sf)), f"skylark_{path.rpartition('-')[2]}", path, buckets=8)

    path = stored(spark, sf, "mentions", build)
    return graph.entity_neighbours(spark.table(f"skylark_{path.rpartition('-')[2]}"), "u1")


@query("daily_overview", _A + f"SELECT e.topic_id, e.date, e.score, e.action, t.name, t.category FROM {_EDGES} e JOIN {_TOPICS} t ON e.topic_id = t.topic_id WHERE e.date = '2024-01-15' ORDER BY e.score DESC, e.topic_id LIMIT 10")
def daily_overview(spark, sf):
    return graph.daily_overview(V.appearances(spark, sf), "2024-01-15")


@query("recommend", _A + f"SELECT topic_id, category, total_score, mention_count, round(total_score * 0.7::DOUBLE + mention_count * 3 * 0.3::DOUBLE, 6) AS weighted FROM {_TOPICS} WHERE last_seen::DATE >= DATE '2024-02-01' - 14 AND contains(category, 'c') ORDER BY weighted DESC, topic_id LIMIT 5")
def recommend(spark, sf):
    return graph.recommend(V.appearances(spark, sf), F.lit("2024-02-01").cast("date"), "c")


@query("source_coverage", _A + f"SELECT t.topic_id, t.total_score, array_to_string(list_sort(list(DISTINCT v.source)), ',') AS sources FROM {_TOPICS} t LEFT JOIN {_VIA} v ON v.topic_id = t.topic_id WHERE contains(t.topic_id, 'view') GROUP BY ALL")
def source_coverage(spark, sf):
    return graph.source_coverage(V.appearances(spark, sf), "view")


# catalogue -------------------------------------------------------------------------------------------------------
@query("repo_state_counts", _I + "SELECT repo, count(*) FILTER (NOT is_pr AND state = 'open') AS open_issues, count(*) FILTER (NOT is_pr AND state = 'closed') AS closed_issues, count(*) FILTER (is_pr AND state = 'open') AS open_prs, count(*) FILTER (is_pr AND state = 'closed') AS closed_prs FROM v_items GROUP BY repo")
def repo_state_counts(spark, sf):
    return catalog.state_counts(V.repo_items(spark, sf))


@query("daily_concat", _R + "SELECT date, md5(string_agg('## ' || report_type || chr(10) || left(content, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY report_type, doc_id)) AS body_md5 FROM v_reports GROUP BY date")
def daily_concat(spark, sf):
    return catalog.daily_concat(V.reports(spark, sf)).select("date", F.md5("body").alias("body_md5"))


@query("digest_parts", _R + """, t AS (SELECT date, report_type, doc_id, '## ' || report_type || chr(10) || left(content, 2000) AS t FROM v_reports),
whole AS (SELECT date, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY report_type, doc_id) AS body FROM t GROUP BY date),
p AS (SELECT date, coalesce(sum(length(t) + 7) OVER (PARTITION BY date ORDER BY report_type, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, length(t) AS n FROM t),
part AS (SELECT date, o // 20000 AS k, min(o) AS a, max(o + n) AS z FROM p GROUP BY ALL)
SELECT date, row_number() OVER (PARTITION BY date ORDER BY k)::INT AS part, greatest(a - 7, 0)::BIGINT AS start, md5(substr(body, greatest(a - 7, 0)::BIGINT + 1, (z - greatest(a - 7, 0))::BIGINT)) AS body_md5 FROM part JOIN whole USING (date)""")
def digest_parts(spark, sf):
    """Each part of a day's digest is the same stretch of the whole."""
    return catalog.digest_parts(V.reports(spark, sf), part_chars=20_000).select("date", "part", "start", F.md5("body").alias("body_md5"))


#: The order of reports, and reports of all its names (and one that is not in it), base and -en.
_ORDER = R.report_order("pool-report")
_NAMES = (*_ORDER, "ai-other")
_NAMED = f"""v_named AS (SELECT doc_id, date, content, ([{", ".join(f"'{n}'" for n in _NAMES)}])[(doc_id // 30) % {len(_NAMES)} + 1] || CASE WHEN doc_id % 4 = 1 THEN '-en' ELSE '' END AS report_type FROM v_reports)"""
_ORD = f"coalesce(list_position([{', '.join(f"'{n}'" for n in _ORDER)}], regexp_replace(report_type, '-en$', '')), 99)"


def _named_reports(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.floor(F.col("doc_id") / 30) % len(_NAMES) + 1).cast("int"))
    return V.reports(spark, sf).withColumn("report_type", F.concat(name, F.when(F.col("doc_id") % 4 == 1, "-en").otherwise("")))


@query("manifest", _R + f", {_NAMED} SELECT date, string_agg(report_type, ',' ORDER BY o, report_type) AS reports FROM (SELECT DISTINCT date, report_type, {_ORD} AS o FROM v_named) GROUP BY date")
def manifest(spark, sf):
    return catalog.manifest(_named_reports(spark, sf), _ORDER).select("date", F.array_join("reports", ",").alias("reports"))


@query("feed_items", _R + f""", {_NAMED} SELECT date, report_type, doc_id, CASE report_type WHEN 'ai-hn' THEN 'Stories &amp; talk' ELSE report_type END || ' ' || date AS title, strftime(date::DATE, '%a, %d %b %Y') || ' 00:00:00 +0000' AS pub_date, replace(replace(replace(replace(CASE WHEN len(t) > 500 THEN left(t, 500) || '...' ELSE t END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS summary,
  'https://example.org/' || CASE report_type WHEN 'pool-report' THEN 'digests/' || date || '/pool-report.html' ELSE '#' || date || '/' || report_type END AS link
FROM (SELECT *, trim(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM v_named) ORDER BY date DESC, {_ORD}, report_type, doc_id LIMIT 30""")
def feed_items(spark, sf):
    return catalog.feed_items(_named_reports(spark, sf), _ORDER, site="https://example.org", labels={"ai-hn": "Stories & talk"})


@query("search_index_topics", f"WITH {V.SIGNALS_SQL} SELECT title, category, score, action, left(evidence[1], 80) AS source FROM v_pool")
def search_index_topics(spark, sf):
    from ..operators.scoring import score_signals

    return catalog.search_topics(score_signals(V.signals(spark, sf), V.now(), RULES))


@query("search_index_excerpts", _R + "SELECT date, report_type, doc_id, left(content, 600) AS excerpt FROM v_reports")
def search_index_excerpts(spark, sf):
    return catalog.search_excerpts(V.reports(spark, sf))


@query("weekly_rollup", _R + "SELECT date, md5(string_agg('## ' || report_type || chr(10) || left(content, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY report_type, doc_id)) AS body_md5 FROM v_reports WHERE date IN (SELECT DISTINCT date FROM v_reports ORDER BY date DESC LIMIT 7) GROUP BY date")
def weekly_rollup(spark, sf):
    return catalog.weekly(V.reports(spark, sf)).select("date", F.md5("body").alias("body_md5"))


@query("monthly_rollup", _R + "SELECT date, md5(string_agg('## ' || report_type || chr(10) || left(content, 3000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY report_type, doc_id)) AS body_md5 FROM v_reports WHERE report_type = 'ai-weekly' AND starts_with(date, '2024-01') GROUP BY date")
def monthly_rollup(spark, sf):
    return catalog.monthly(V.reports(spark, sf), "2024-01").select("date", F.md5("body").alias("body_md5"))


_SOURCES = f"[{', '.join(repr(n) for n in R.ROLLUP_SOURCES)}]"
_ONE = f"""{_NAMED}, one AS (SELECT date, report_type, arg_min(content, doc_id) AS content FROM v_named GROUP BY ALL),
day AS (SELECT date, string_agg(CASE WHEN len(content) > 2500 THEN left(content, 2500) || chr(10) || '...[摘要截断]' ELSE content END, chr(10) || chr(10) ORDER BY list_position({_SOURCES}, report_type)) AS body FROM one WHERE list_contains({_SOURCES}, report_type) GROUP BY date)"""


def _one_of_each(spark, sf):
    r = _named_reports(spark, sf)
    return r.groupBy("date", "report_type").agg(F.min_by("content", "doc_id").alias("content"))


@query("week_digests", _R + f", {_ONE} SELECT date, md5(body) AS body_md5 FROM day WHERE date IN (SELECT DISTINCT date FROM one ORDER BY date DESC LIMIT 7)")
def week_digests(spark, sf):
    return catalog.week_digests(_one_of_each(spark, sf), R.ROLLUP_SOURCES).select("date", F.md5("body").alias("body_md5"))


@query("month_digests", _R + "SELECT date, md5(CASE WHEN len(content) > 3000 THEN left(content, 3000) || chr(10) || '...[截断]' ELSE content END) AS body_md5 FROM (SELECT date, arg_min(content, doc_id) AS content FROM v_reports WHERE report_type = 'ai-weekly' GROUP BY date)")
def month_digests(spark, sf):
    one = V.reports(spark, sf).groupBy("date", "report_type").agg(F.min_by("content", "doc_id").alias("content"))
    return catalog.month_digests(one, R.ROLLUP_SOURCES, "2024-01").select("date", F.md5("body").alias("body_md5"))


@query("month_digests_sampled", _R + f", {_ONE} SELECT date, md5(body) AS body_md5 FROM day WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS i FROM (SELECT DISTINCT date FROM one WHERE report_type <> 'ai-weekly')) WHERE i % 4 = 0 AND i < 40)")
def month_digests_sampled(spark, sf):
    """A month without weekly reports."""
    return catalog.month_digests(_one_of_each(spark, sf).filter("report_type <> 'ai-weekly'"), R.ROLLUP_SOURCES, "2024-01").select("date", F.md5("body").alias("body_md5"))


@query("week_digest_text", _R + f", {_ONE} SELECT min(date) AS first, max(date) AS last, md5(string_agg('## ' || date || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY date DESC)) AS text_md5 FROM day WHERE date IN (SELECT DISTINCT date FROM one ORDER BY date DESC LIMIT 7)")
def week_digest_text(spark, sf):
    return catalog.digest_text(catalog.week_digests(_one_of_each(spark, sf), R.ROLLUP_SOURCES)).select("first", "last", F.md5("text").alias("text_md5"))


@query("social_text", _R + f", {_ONE}, own AS (SELECT date, string_agg('## [' || report_type || ']' || chr(10) || chr(10) || left(content, 1000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY list_position({_SOURCES}, report_type)) AS body FROM one WHERE list_contains({_SOURCES}, report_type) AND date IN (SELECT DISTINCT date FROM one ORDER BY date DESC LIMIT 30) GROUP BY date) SELECT min(date) AS first, max(date) AS last, md5(string_agg('# ' || date || chr(10) || chr(10) || body, chr(10) || chr(10) || '===' || chr(10) || chr(10) ORDER BY date DESC)) AS text_md5 FROM own")
def social_text(spark, sf):
    return catalog.social_text(_one_of_each(spark, sf), R.ROLLUP_SOURCES, 30, 1000).select("first", "last", F.md5("text").alias("text_md5"))


@query("latest_report", _R + "SELECT report_type, arg_max(doc_id, {'d': date, 'i': doc_id}) AS doc_id, max(date) AS date FROM v_reports GROUP BY 1")
def latest_report(spark, sf):
    return catalog.latest_report(V.reports(spark, sf))


@query("get_report", _R + "SELECT doc_id, md5(content) AS content_md5 FROM v_reports WHERE date = '2024-01-06' AND report_type = 'ai-src5'")
def get_report(spark, sf):
    return catalog.get_report(V.reports(spark, sf), "2024-01-06", "ai-src5").select("doc_id", F.md5("content").alias("content_md5"))


@query("list_reports", _R + "SELECT date, report_type, count(*) AS n FROM v_reports WHERE date IN (SELECT DISTINCT date FROM v_reports ORDER BY date DESC LIMIT 7) GROUP BY ALL")
def list_reports(spark, sf):
    return catalog.list_reports(V.reports(spark, sf), 7)


@query("report_selection", _R + "SELECT date, report_type, doc_id, contains(report_type, 'weekly') OR contains(report_type, 'monthly') AS is_rollup FROM v_reports WHERE NOT ends_with(report_type, '-en')")
def report_selection(spark, sf):
    return catalog.selected_reports(V.reports(spark, sf)).select("date", "report_type", "doc_id", "is_rollup")


@query("highlights_merge", "SELECT lang, source AS report, arg_max(doc_id, {'p': (doc_id % 2), 'd': -doc_id}) AS doc_id FROM (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source, doc_id % 2) GROUP BY ALL")
def highlights_merge(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang", F.col("source").alias("report"), (F.col("doc_id") % 2).alias("new")).agg(F.min("doc_id").alias("doc_id"))
    return catalog.merged_highlights(d.filter("new = 0").drop("new"), d.filter("new = 1").drop("new"))


@query("partition_by_ids", "SELECT doc_id, source IN ('src1', 'src5', 'src9') AS chosen FROM documents")
def partition_by_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    a, b = store.partition_by_ids(d, "source", d.select("source").distinct().filter(F.col("source").isin("src1", "src5", "src9")))
    return a.select("doc_id", F.lit(True).alias("chosen")).unionByName(b.select("doc_id", F.lit(False).alias("chosen")))


# crawl -----------------------------------------------------------------------------------------------------------
_DIFF = """d AS (SELECT f.*, s.lastmod AS old, f.site IN (SELECT site FROM v_state) AS known_site FROM v_site f LEFT JOIN v_state s ON s.site = f.site AND s.url = f.url),
fresh AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lastmod DESC NULLS LAST, url) AS n FROM d WHERE old IS NULL OR (site <> 'site1' AND lastmod > old)),
diff AS (SELECT * FROM fresh WHERE known_site OR n <= 25)"""


def _diff(spark, sf):
    return crawl.crawl_diff(V.sitemap(spark, sf).select("page_id", "site", "url", "lastmod"), V.crawl_state(spark, sf), ("site1",))


@query("crawl_diff", _M + f", {_DIFF} SELECT page_id, site, lastmod, known_site FROM diff")
def crawl_diff(spark, sf):
    return _diff(spark, sf).select("page_id", "site", "lastmod", "known_site")


@query("crawl_state_next", _M + "SELECT coalesce(f.site, s.site) AS site, coalesce(f.url, s.url) AS url, coalesce(f.lastmod, 'seen') AS lastmod FROM v_site f FULL JOIN v_state s ON s.site = f.site AND s.url = f.url")
def crawl_state_next(spark, sf):
    return crawl.next_state(V.sitemap(spark, sf), V.crawl_state(spark, sf))


@query("crawl_summary", _M + f", {_DIFF} SELECT t.site, t.total, coalesce(n.new, 0) AS new, coalesce(n.first_run, false) AS first_run FROM (SELECT site, count(*) AS total FROM v_site GROUP BY ROLLUP (site)) t LEFT JOIN (SELECT site, count(*) AS new, bool_or(NOT known_site) AS first_run FROM diff GROUP BY ROLLUP (site)) n ON n.site IS NOT DISTINCT FROM t.site")
def crawl_summary(spark, sf):
    return crawl.crawl_summary(V.sitemap(spark, sf).select("site", "url"), _diff(spark, sf))


# conversation store ----------------------------------------------------------------------------------------------
@query("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf):
    return store.upsert_latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("patch_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def patch_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return store.patch(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")), "c_custkey")


@query("list_agents", _T + "SELECT agent_id, type, created_at FROM v_agents WHERE type = 't0' AND active ORDER BY created_at DESC LIMIT 5 OFFSET 1")
def list_agents(spark, sf):
    return store.list_agents(V.agents(spark, sf), "t0", True, 1, 5).select("agent_id", "type", "created_at")


@query("agent_conversations", _T + "SELECT conv_id, updated_at FROM v_conv WHERE agent_id = 3 ORDER BY updated_at DESC LIMIT 20")
def agent_conversations(spark, sf):
    return store.agent_conversations(V.agents(spark, sf), V.conversations(spark, sf), 3, 20).select("conv_id", "updated_at")


@query("conversation_messages", _T + "SELECT turn, role, md5(text) AS text_md5, token_count FROM v_msg WHERE conv_id = 7 ORDER BY ts LIMIT 50")
def conversation_messages(spark, sf):
    return store.conversation_messages(V.messages(spark, sf), 7, 50).select("turn", "role", F.md5("text").alias("text_md5"), "token_count")


@query("last_turns", _T + "SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, turn DESC)::INT AS back FROM v_msg) WHERE back <= 10")
def last_turns(spark, sf):
    return store.last_turns(V.messages(spark, sf)).select("conv_id", "turn", "back")


@query("conversation_touch", _T + "SELECT c.conv_id, greatest(c.updated_at, m.ts) AS updated_at FROM v_conv c JOIN (SELECT conv_id, max(ts) AS ts FROM v_msg GROUP BY 1) m ON m.conv_id = c.conv_id")
def conversation_touch(spark, sf):
    return store.touch(V.conversations(spark, sf), V.messages(spark, sf)).select("conv_id", "updated_at")


@query("delete_cascade", _T + "SELECT conv_id, turn FROM v_msg WHERE conv_id % 10 NOT IN (2, 5)")
def delete_cascade(spark, sf):
    a = V.agents(spark, sf)
    return store.delete_cascade(a, V.conversations(spark, sf), V.messages(spark, sf), a.select("agent_id").filter(F.col("agent_id").isin(2, 5)))[2].select("conv_id", "turn")


@query("agent_topics", "SELECT agent_id, topic, relationship, n FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, topic)::INT AS n FROM (SELECT user_id % 10 AS agent_id, event_type || '-' || user_id AS topic, arg_max(CASE WHEN event_id % 3 = 0 THEN 'RELATED_TO' ELSE 'USES' END, ts) AS relationship, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE n <= 50")
def agent_topics(spark, sf):
    links = table(spark, sf, "events").select((F.col("user_id") % 10).alias("agent_id"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("topic"), F.when(F.col("event_id") % 3 != 0, "USES").alias("relationship"), "ts")
    return store.agent_topics(links, 50).select("agent_id", "topic", "relationship", "n")


@query("config_json", "SELECT event_id, props->>'$.k' AS k FROM events")
def config_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_element_at(store.config_from_json(F.col("props")), F.lit("k")).alias("k"))


# retrieval -------------------------------------------------------------------------------------------------------
_COS = "1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _first(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


@query("vector_topk", f"SELECT e.vec_id, round({_COS}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY {_COS}, e.vec_id LIMIT 10")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.vector_topk(e, _first(spark, sf), 10, F.col("vec_id") != 0).select("vec_id", F.round("distance", 6).alias("distance"))


_BATCH = f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id)::INT AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 10"


@query("vector_topk_batch", _BATCH)
def vector_topk_batch(spark, sf):
    """Every row whose id is divisible by 50 asks all rows but itself."""
    e = table(spark, sf, "embeddings")
    return retrieval.vector_topk_batch(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "rank")


_INDEXES: dict[str, vector_index.VectorIndex] = {}


def _vector_index(spark, sf):
    """Built by the first query of an application that asks it; only centres and counts of cells stay with the driver."""

    def build(path: str) -> None:
        _INDEXES[path] = vector_index.build(table(spark, sf, "embeddings"), path)

    return _INDEXES[stored(spark, sf, "vector_index", build)]


@query("vector_topk_indexed")
def vector_topk_indexed(spark, sf):
    """As vector_topk_batch, through the stored index: approximate, with exact distances."""
    e = table(spark, sf, "embeddings").filter("vec_id % 50 = 0")
    return vector_index.nearest(_vector_index(spark, sf), e, 10).select("query_id", "vec_id", "rank")


@query("vector_index_recall", f"SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_wanted, true AS recall_90, (SELECT count(*) FROM embeddings e WHERE list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) > 0) AS n_indexed FROM ({_BATCH})")
def vector_index_recall(spark, sf):
    """Whether the index finds nine of ten of the exact neighbours of all queries, and how many rows it holds."""
    want, got = vector_topk_batch(spark, sf), vector_topk_indexed(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit"))
    held = vector_index.stored_rows(spark, _vector_index(spark, sf)).agg(F.count("*").alias("n_indexed"))
    recall = want.join(got, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_90"))
    return recall.crossJoin(held)  # two single rows


_TERMS = ("the", "license", "erin")
def _bm25(docs, key, text, terms):
    """CTEs b, s and bm: BM25 of the terms over a table."""
    w = f"regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"
    return f"""b AS (SELECT {key}, len({w})::DOUBLE AS len, {", ".join(f"len(list_filter({w}, lambda w: w = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))} FROM {docs}),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, {", ".join(f"count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))} FROM b),
bm AS (SELECT {key}, {" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))" for i in range(len(terms)))} AS score FROM b, s)"""


_BM25 = _bm25("documents", "doc_id", "text", _TERMS)


def _text_index(spark, sf):
    """The documents' inverted index, built by the first query that asks it."""
    return stored(spark, sf, "fulltext", lambda path: fulltext.write_index(table(spark, sf, "documents"), path, "doc_id", "text"))


@query("fulltext_docs", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0")
def fulltext_docs(spark, sf):
    return fulltext.search(spark, _text_index(spark, sf), _TERMS, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("fulltext_vocabulary", r"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def fulltext_vocabulary(spark, sf):
    """Each word of the index with its document and corpus frequency."""
    return fulltext.vocabulary(spark, _text_index(spark, sf))


@query("fulltext_growing", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0")
def fulltext_growing(spark, sf):
    """An index that two further sets of documents are added to answers as if all had come at once."""
    d, at = table(spark, sf, "documents"), scratch(spark)
    for third in range(3):
        fulltext.write_index(d.filter(F.col("doc_id") % 3 == third), at, "doc_id", "text")
    return fulltext.search(spark, at, _TERMS, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("fulltext_topics", _A + f""", ents AS (SELECT DISTINCT entity_id FROM {_MENTIONS}), {_bm25("ents", "entity_id", "entity_id", ("click", "u12", "u7"))}, e AS (SELECT * FROM bm WHERE score > 0)
SELECT h.topic_id, round(h.score, 6) AS score, t.total_score FROM (SELECT topic_id, max(score) AS score FROM e JOIN {_MENTIONS} m ON m.entity_id = e.entity_id GROUP BY 1) h JOIN {_TOPICS} t ON t.topic_id = h.topic_id ORDER BY h.score DESC, t.total_score DESC, h.topic_id LIMIT 20""")
def fulltext_topics(spark, sf):
    a = V.appearances(spark, sf)
    m = graph.mentions(a)
    scores = retrieval.entity_search(m.select("entity_id", F.col("entity_id").alias("name")).distinct(), "u7 Click, u12!")
    return retrieval.fulltext_topics(scores, m, graph.topics(a), 20).select("topic_id", F.round("score", 6).alias("score"), "total_score")


def _lists(spark, sf):
    from pyspark.sql import Window

    ranked = lambda df, col: df.orderBy(F.desc(col), "key").limit(50).withColumn("rank0", F.row_number().over(Window.orderBy(F.desc(col), "key")) - 1)  # noqa: E731  50 rows
    d = table(spark, sf, "documents").select(F.md5("text").alias("key"), "n_chars", (F.col("doc_id") % 997).alias("other")).groupBy("key").agg(F.max("n_chars").alias("n_chars"), F.max("other").alias("other"))
    return ranked(d, "n_chars"), ranked(d, "other")


_LISTS = """d AS (SELECT md5(text) AS key, max(n_chars) AS n_chars, max(doc_id % 997) AS other FROM documents GROUP BY 1),
l AS (SELECT key, 0 AS list_ord, row_number() OVER (ORDER BY n_chars DESC, key) - 1 AS rank0 FROM d UNION ALL SELECT key, 1, row_number() OVER (ORDER BY other DESC, key) - 1 FROM d)"""


@query("rrf_fusion", f"WITH {_LISTS} SELECT key, round(sum(1.0::DOUBLE / (60 + rank0 + 1)), 6) AS score FROM l WHERE rank0 < 50 GROUP BY key ORDER BY score DESC, key LIMIT 20")
def rrf_fusion(spark, sf):
    a, b = _lists(spark, sf)
    return retrieval.rrf(a.select(F.lit(0).alias("list_ord"), "rank0", "key").unionByName(b.select(F.lit(1).alias("list_ord"), "rank0", "key")), 20)


@query("hybrid_search", f"""WITH {_BM25}, near AS (SELECT 'doc-' || e.vec_id AS key, row_number() OVER (ORDER BY {_COS}, e.vec_id) - 1 AS rank0 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank0 < 20),
txt AS (SELECT 'doc-' || doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank0 FROM bm WHERE score > 0 QUALIFY rank0 < 20)
SELECT key, round(sum(1.0::DOUBLE / (60 + rank0 + 1)), 6) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM txt) GROUP BY key ORDER BY score DESC, key LIMIT 10""")
def hybrid_search(spark, sf):
    from pyspark.sql import Window

    near = retrieval.vector_topk(table(spark, sf, "embeddings"), _first(spark, sf), 20).select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("key"), "distance", "vec_id")
    text = fulltext.search(spark, _text_index(spark, sf), _TERMS, "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("key"), "score", "doc_id")
    a = near.select("key", (F.row_number().over(Window.orderBy("distance", "vec_id")) - 1).alias("rank0"))
    b = text.select("key", (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("rank0"))
    return retrieval.hybrid_search(a, b, 10)


@query("search_rendered", f"""WITH {_BM25} SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS n, row_number() OVER (ORDER BY score DESC, doc_id) || '. [2024-01-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') || '/' || source || '] ' || left(text, 200) AS line
FROM (SELECT bm.doc_id, score, source, text FROM bm JOIN documents USING (doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5)""")
def search_rendered(spark, sf):
    d = table(spark, sf, "documents")
    best = fulltext.search(spark, _text_index(spark, sf), _TERMS, "doc_id").orderBy(F.desc("score"), "doc_id").limit(5)
    hits = best.join(d.select("doc_id", "source", "text"), "doc_id").withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd"))
    return retrieval.rendered_hits(hits, [F.desc("score"), "doc_id"])


_KW = ("the", "license", "heble")
_HITS = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in _KW) + ")::INT"


@query("keyword_search", f"SELECT doc_id, {_HITS} AS hits FROM documents WHERE {_HITS} > 0 ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 10")
def keyword_search(spark, sf):
    d = table(spark, sf, "documents")
    return retrieval.keyword_search(d, F.col("text"), _KW, 10, [F.desc("n_chars"), "doc_id"]).select("doc_id", "hits")


@query("line_search", _R + "SELECT doc_id, date, array_to_string(list_filter(string_split(content, chr(10)), lambda x: contains(lower(x), 'license'))[1:3], chr(10)) AS lines FROM v_reports WHERE contains(lower(content), 'license') AND date IN (SELECT DISTINCT date FROM v_reports ORDER BY date DESC LIMIT 14)")
def line_search(spark, sf):
    r = V.reports(spark, sf)
    return retrieval.line_search(r, "License", catalog.latest_dates(r, 14)).select("doc_id", "date", F.array_join("lines", "\n").alias("lines"))


_IDX = f"""WITH {V.SIGNALS_SQL}, idx AS (SELECT title, category, left(evidence[1], 80) AS source, reason, array_to_string(evidence, ' ') AS evidence, score, strftime(DATE '2024-01-01' + (item_ord % 30)::INT, '%Y-%m-%d') AS date, item_ord FROM v_pool)"""
_KW2 = ("src1", "er", "the")


def _index(spark, sf):
    from ..operators.scoring import score_signals

    s = score_signals(V.signals(spark, sf), V.now(), RULES)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_ord") % 30).cast("int")), "yyyy-MM-dd")
    return s.select("title", "category", F.substring(F.get("evidence", F.lit(0)), 1, 80).alias("source"), "reason", F.array_join("evidence", " ").alias("evidence"), "score", "action", day.alias("date"), "item_ord")


def _stored_index(spark, sf):
    """The search index as it is written once, by date."""
    return sinks.read_search_index(spark, stored(spark, sf, "search_index", lambda path: sinks.write_search_index(_index(spark, sf), path)))


@query("search_index_stored", _IDX + " SELECT date, title, category, source, reason, evidence, score, item_ord FROM idx")
def search_index_stored(spark, sf):
    """The search index, written under its dates and read back."""
    return _stored_index(spark, sf).select("date", "title", "category", "source", "reason", "evidence", "score", "item_ord")


def _h(text):
    return "(" + " + ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END" for w in _KW2) + ")::INT"


_BEST = f"""best AS (SELECT *, row_number() OVER (ORDER BY hits DESC, score DESC, item_ord) AS n FROM (SELECT *, {_h("title || ' ' || category || ' ' || source")} AS hits FROM idx) WHERE hits > 0 QUALIFY n <= 10)"""


@query("chat_context", _IDX + f""", {_BEST}, days AS (SELECT date, min(n) AS d FROM best GROUP BY date ORDER BY d LIMIT 3),
hit AS (SELECT idx.*, d, {_h("title || ' ' || category || ' ' || reason || ' ' || evidence")} AS hits FROM idx JOIN days ON days.date = idx.date),
top AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY hits DESC, score DESC, item_ord) AS n FROM hit WHERE hits > 0 QUALIFY n <= 8)
SELECT date, title, hits, score FROM top QUALIFY row_number() OVER (PARTITION BY title ORDER BY d, n) = 1""")
def chat_context(spark, sf):
    return retrieval.chat_context(_stored_index(spark, sf), _KW2)


@query("citations", f"WITH {V.REPORTS_SQL}, {_IDX[5:]}, {_BEST}, days AS (SELECT date, min(n) AS n FROM best WHERE n <= 5 GROUP BY date)," + """
lines AS (SELECT r.date, report_type, doc_id, n, list_filter(string_split(left(content, 600), chr(10)), lambda x: contains(lower(x), 'src1') OR contains(lower(x), 'er') OR contains(lower(x), 'the'))[1] AS line FROM v_reports r JOIN days ON days.date = r.date)
SELECT date, report_type, left(line, 150) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY date, report_type ORDER BY doc_id) AS m FROM lines WHERE line IS NOT NULL) WHERE m = 1 ORDER BY n, report_type, doc_id LIMIT 6""")
def citations(spark, sf):
    from pyspark.sql import Window

    text = F.concat_ws(" ", "title", "category", "source")
    best = retrieval.keyword_search(_stored_index(spark, sf), text, _KW2, 5, [F.desc("score"), "item_ord"])
    best = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("score"), "item_ord")))  # five rows
    return retrieval.citations(best.select("date", "n"), catalog.search_excerpts(V.reports(spark, sf)), _KW2)


@query("chat_context_fallback", _IDX + f"""SELECT date, n, title, score FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY hits DESC, score DESC, item_ord)::INT AS n FROM (SELECT *, {_h("title || ' ' || category || ' ' || reason || ' ' || evidence")} AS hits FROM idx) WHERE hits > 0 AND date IN (SELECT DISTINCT date FROM idx ORDER BY date DESC LIMIT 5)) WHERE n <= 3""")
def chat_context_fallback(spark, sf):
    i = _stored_index(spark, sf)
    return retrieval.chat_fallback(i, _KW2, catalog.latest_dates(i, 5))


_STRIP = r"trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))"


def _spans_sql(name, source, key, separator):
    """CTE: the places [a, b) of what lies between the separators of ``source`` (key, t, base), as lists s."""
    size = f"len({separator})"
    return f"""{name} AS (SELECT {key}, list_transform(p, lambda x, i: {{'a': base + coalesce(list_sum(list_transform(p[1 : i - 1], lambda y: len(y) + {size})), 0)::BIGINT,
  'b': base + coalesce(list_sum(list_transform(p[1 : i - 1], lambda y: len(y) + {size})), 0)::BIGINT + len(x)}}) AS s FROM (SELECT {key}, base, string_split(t, {separator}) AS p FROM {source}))"""


def _packed_sql(name, spans, key, limit, step=None):
    """CTEs: spans s of each row of ``spans`` taken one by one and joined while they fit; {name} holds (key, a, b), and what is
    too long by itself in windows every ``step``, or as it is."""
    free = f"(ra IS NULL OR ra = rb OR s[i].b - ra > {limit})"
    long = f"s[i].b - s[i].a > {limit}"
    n = f"greatest(0, (s[i].b - {limit} - s[i].a + {step} - 1) // {step})"
    cut = f"list_transform(range({n}), lambda j: {{'a': s[i].a + j * {step}, 'b': s[i].a + j * {step} + {limit}}})" if step else "[s[i]]"
    rest = f"s[i].a + {n} * {step}" if step else "NULL"
    end = "s[i].b" if step else "NULL"
    return f"""{name}_steps AS (SELECT {key}, s, 1::BIGINT AS i, NULL::BIGINT AS ra, NULL::BIGINT AS rb, []::STRUCT(a BIGINT, b BIGINT)[] AS done FROM {spans}
  UNION ALL SELECT {key}, s, i + 1, CASE WHEN NOT {free} THEN ra WHEN {long} THEN {rest} ELSE s[i].a END, CASE WHEN {free} AND {long} THEN {end} ELSE s[i].b END,
    CASE WHEN NOT {free} THEN [] ELSE CASE WHEN ra < rb THEN [{{'a': ra, 'b': rb}}] ELSE [] END || CASE WHEN {long} THEN {cut} ELSE [] END END FROM {name}_steps WHERE i <= len(s)),
{name} AS (SELECT {key}, x.a AS a, x.b AS b FROM (SELECT {key}, unnest(done) AS x FROM {name}_steps) UNION ALL SELECT {key}, ra, rb FROM {name}_steps WHERE i = len(s) + 1 AND ra < rb)"""


#: A line that begins with ## and a space is a header; the last line of all may be a bare ##, which is none.
_CHUNKS = f"""WITH RECURSIVE {V.REPORTS_SQL}, lines AS (SELECT doc_id, date, report_type, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n FROM v_reports WHERE content IS NOT NULL),
numbered AS (SELECT *, sum(CASE WHEN i > 1 AND (regexp_matches(line, '^##\\s') OR line = '##' AND i < n) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM lines),
sections AS (SELECT doc_id, date, report_type, part, {_STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS t, 0::BIGINT AS base FROM numbered GROUP BY ALL),
{_spans_sql("paragraphs", "(SELECT * FROM sections WHERE len(t) > 1000)", "doc_id, part", "chr(10) || chr(10)")},
{_packed_sql("pieces", "paragraphs", "doc_id, part", 1000, 800)},
cuts AS (SELECT doc_id, part, a, b FROM pieces UNION ALL SELECT doc_id, part, 0, len(t) FROM sections WHERE len(t) <= 1000),
texts AS (SELECT doc_id, date, report_type, part, a, {_STRIP.format("substring(t, a + 1, b - a)")} AS text FROM cuts JOIN sections USING (doc_id, part)),
v_chunks AS (SELECT date || '/' || report_type || '/' || doc_id || '/' || (row_number() OVER (PARTITION BY doc_id ORDER BY part, a) - 1) AS chunk_id, date, text FROM texts WHERE len(text) > 20) """


@query("chunk_documents", _CHUNKS + "SELECT chunk_id, date, len(text)::INT AS chars, md5(text) AS text_md5 FROM v_chunks")
def chunk_documents(spark, sf):
    return retrieval.chunk_documents(V.reports(spark, sf)).select("chunk_id", "date", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def _stored_chunks(spark, sf):
    """The reports' chunks, cut by the first query that asks for them."""
    return spark.read.parquet(stored(spark, sf, "chunks", lambda path: retrieval.chunk_documents(V.reports(spark, sf)).write.parquet(path)))


@query("embed_chunks")
def embed_chunks(spark, sf):
    e = retrieval.embed_chunks(_stored_chunks(spark, sf))
    given = F.unwrap_udt("embedding")["values"]  # the zeros add nothing
    return e.select("chunk_id", F.round(F.aggregate(given, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("chunk_terms", _CHUNKS + """, tf AS (SELECT chunk_id, w, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM v_chunks) GROUP BY ALL),
df AS (SELECT w, ln((SELECT count(*) + 1 FROM v_chunks) / (count(*) + 1)::DOUBLE) AS idf FROM tf GROUP BY w), weighed AS (SELECT *, tf * idf AS x FROM tf JOIN df USING (w)),
unit AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS norm FROM weighed)
SELECT chunk_id, count(*) AS n_terms, round(any_value(norm), 6) AS norm, arg_min(w, {'x': -x, 'w': w}) AS top_term, round(max(CASE WHEN norm > 0 THEN x / norm ELSE 0 END), 6) AS top_weight FROM unit GROUP BY chunk_id""")
def chunk_terms(spark, sf):
    """Weights of the chunks' terms, one row for each chunk: their number, their norm and the heaviest one."""
    t = retrieval.term_vectors(_stored_chunks(spark, sf), "chunk_id", "text")
    best = F.array_min(F.transform("terms", lambda x: F.struct((-x["weight"]).alias("w"), x["term"].alias("term"))))
    return t.select("chunk_id", F.size("terms").cast("long").alias("n_terms"), F.round("norm", 6).alias("norm"), best["term"].alias("top_term"), F.round(-best["w"], 6).alias("top_weight"))


@query("chunk_counts", _R + "SELECT date, count(*) AS n FROM v_reports WHERE date >= '2024-01-10' GROUP BY ROLLUP (date)")
def chunk_counts(spark, sf):
    """Rows of the chunk store by date, and of all (date null)."""
    return retrieval.store_counts(V.reports(spark, sf).filter("date >= '2024-01-10'"))


@query("chunks_replace_date", _R + "SELECT doc_id, date, CASE WHEN date IN ('2024-01-03', '2024-01-04') THEN 'new' ELSE 'old' END AS version FROM v_reports")
def chunks_replace_date(spark, sf):
    r = V.reports(spark, sf).select("doc_id", "date")
    return retrieval.replace_dates(r.withColumn("version", F.lit("old")), r.filter(F.col("date").isin("2024-01-03", "2024-01-04")).withColumn("version", F.lit("new")))


# assembly --------------------------------------------------------------------------------------------------------
_NOTE = lambda n, k: f"CASE WHEN {n} > {k} THEN '(Total: ' || {n} || ' items; showing top {k} by comment count)' ELSE '(Total: ' || {n} || ' items)' END"


@query("sample_note", _I + f"SELECT repo, {_NOTE('count(*)', 30)} AS note FROM v_items GROUP BY repo")
def sample_note(spark, sf):
    return V.repo_items(spark, sf).groupBy("repo").agg(F.count("*").alias("n")).select("repo", assembly.sample_note(F.col("n"), 30).alias("note"))


from .signal_queries import _ITEM  # noqa: E402

_CTX = f"""top AS (SELECT *, row_number() OVER (PARTITION BY repo, is_pr ORDER BY comments DESC, number) AS n FROM v_items QUALIFY n <= CASE WHEN is_pr THEN 20 ELSE 30 END),
ctx AS (SELECT repo, 'Issues ' || {_NOTE('i', 30)} || ', PRs ' || {_NOTE('p', 20)} || chr(10) || lines AS context FROM (SELECT repo, count(*) FILTER (NOT is_pr) AS i, count(*) FILTER (is_pr) AS p FROM v_items GROUP BY repo)
  JOIN (SELECT repo, string_agg({_ITEM}, chr(10) ORDER BY is_pr, n) AS lines FROM top GROUP BY repo) USING (repo)),
full_ AS (SELECT r.repo, coalesce(context, 'No activity') AS context FROM (SELECT DISTINCT c_mktsegment AS repo FROM customer UNION SELECT 'QUIET') r LEFT JOIN ctx ON ctx.repo = r.repo)"""


def _contexts(spark, sf):
    repos = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("repo")).distinct().unionByName(spark.range(1).select(F.lit("QUIET").alias("repo")))
    return assembly.repo_context(V.repo_items(spark, sf), repos)


@query("repo_context", _I + f", {_CTX} SELECT repo, md5(context) AS context_md5 FROM full_")
def repo_context(spark, sf):
    return _contexts(spark, sf).select("repo", F.md5("context").alias("context_md5"))


@query("comparison_context", _I + f", {_CTX} SELECT md5(string_agg('## ' || repo || chr(10) || context, chr(10) || chr(10) ORDER BY repo)) AS context_md5 FROM full_")
def comparison_context(spark, sf):
    return assembly.comparison_context(_contexts(spark, sf)).select(F.md5("context").alias("context_md5"))


_TOP30 = "(SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)"
_PAPER = """n || '. **' || left(text, 60) || '**' || chr(10) || '   Link: u' || doc_id || chr(10) || '   Authors: ' || array_to_string(string_split(left(text, 80), ' ')[1:3], ', ') || CASE WHEN len(string_split(left(text, 80), ' ')) > 3 THEN ' et al.' ELSE '' END
  || ' | Categories: ' || lang || ', ' || source || chr(10) || '   Published: 2024-01-31' || chr(10) || '   Abstract: ' || left(text, 300) || CASE WHEN len(text) > 300 THEN '...' ELSE '' END"""
_MODEL = """n || '. **' || source || '/' || doc_id || '**' || chr(10) || '   链接: u' || doc_id || chr(10) || '   作者: ' || source || ' | 任务: ' || CASE WHEN doc_id % 2 = 0 THEN 'N/A' ELSE lang END || chr(10) || '   点赞: ' || format('{:,}', n_chars) || ' | 下载: ' || format('{:,}', doc_id * 1000)
  || chr(10) || '   标签: ' || array_to_string(string_split(left(text, 80), ' ')[1:5], ', ')"""


@query("source_contexts", f"""SELECT 'papers' AS source, count(*) AS n, md5(string_agg({_PAPER}, chr(10) || chr(10) ORDER BY n)) AS text_md5 FROM {_TOP30} t UNION ALL SELECT 'models', count(*), md5(string_agg({_MODEL}, chr(10) || chr(10) ORDER BY n)) FROM {_TOP30} t
UNION ALL SELECT 'stories', 0, md5('(none)')""")
def source_contexts(spark, sf):
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).withColumn("url", F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    words, order = F.split(F.substring("text", 1, 80), " "), [F.desc("n_chars"), "doc_id"]
    papers = d.select("*", F.substring("text", 1, 60).alias("title"), words.alias("authors"), F.array("lang", "source").alias("categories"), F.lit("2024-01-31T00:00").alias("published"), F.col("text").alias("summary"))
    models = d.select("*", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("author"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("pipeline_tag"), F.col("n_chars").alias("likes"), (F.col("doc_id") * 1000).alias("downloads"), words.alias("tags"))
    none = papers.limit(0).select("*", *[F.lit("").alias(c) for c in ("hn_url", "points", "comments", "author", "created_at")])
    lists = [("papers", contexts.source_list(papers, "papers", order, "en")), ("models", contexts.source_list(models, "models", order)), ("stories", contexts.source_list(none, "stories", order, "en", "(none)"))]
    parts = [t.select(F.lit(name).alias("source"), "n", F.md5("text").alias("text_md5")) for name, t in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("list_cap_text", "SELECT doc_id, array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' et al.' ELSE '' END AS names FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def list_cap_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", assembly.capped_list(F.split("text", " "), 3).alias("names"))


_BLOCKS = f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t, 0::BIGINT AS base FROM documents),
marked AS (SELECT doc_id, base, regexp_replace(t, chr(10) || '(## |📡 |📅 |📆 |<a )', chr(1) || '\\1', 'g') AS t FROM texts WHERE len(t) > 3400),
{_spans_sql("blocks", "marked", "doc_id", "chr(1)")},
{_packed_sql("runs", "blocks", "doc_id", 3400)},
long AS (SELECT doc_id, a AS base, substring(t, a + 1, b - a) AS t FROM runs JOIN texts USING (doc_id) WHERE b - a > 3400),
{_spans_sql("lines", "long", "doc_id, base", "chr(10)")},
{_packed_sql("stretches", "lines", "doc_id, base", 3400)},
cuts AS (SELECT doc_id, a, b FROM runs WHERE b - a BETWEEN 1 AND 3400 UNION ALL SELECT doc_id, a, b FROM stretches WHERE a < b UNION ALL SELECT doc_id, 0, len(t) FROM texts WHERE len(t) <= 3400)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS pos, (b - a)::INT AS chars, md5(substring(t, a + 1, b - a)) AS block_md5 FROM cuts JOIN texts USING (doc_id)"""


@query("pack_blocks", _BLOCKS)
def pack_blocks(spark, sf):
    return assembly.pack_blocks(table(spark, sf, "documents"), "doc_id").select("doc_id", "pos", F.length("block").alias("chars"), F.md5("block").alias("block_md5"))


_ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("pool_message", f"""WITH {V.SIGNALS_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY score DESC, src_ord, item_ord)::INT AS rank FROM (SELECT * FROM v_pool ORDER BY score DESC, src_ord, item_ord LIMIT 60))
SELECT action, rank, rank || '. ' || {_ESC("title")} || chr(10) || score || ' / ' || action || chr(10) || {_ESC("recommended_topic")} || chr(10) || array_to_string(evidence[1:3], '；') AS line FROM top WHERE rank <= CASE action WHEN '深挖' THEN 6 WHEN '入池' THEN 10 ELSE 0 END""")
def pool_message(spark, sf):
    from ..operators.scoring import topic_radar

    return assembly.pool_message(topic_radar(V.signals(spark, sf), V.now(), RULES), {"深挖": 6, "入池": 10})


@query("report_links", "WITH r AS (SELECT DISTINCT strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS date, 'ai-' || source || CASE WHEN lang = 'en' THEN '-en' ELSE '' END AS report FROM documents) SELECT a.date, a.report, b.report IS NOT NULL AS has_en, contains(a.report, 'weekly') OR contains(a.report, 'monthly') AS is_rollup FROM r a LEFT JOIN r b ON a.date = b.date AND b.report = a.report || '-en' WHERE NOT ends_with(a.report, '-en')")
def report_links(spark, sf):
    d = table(spark, sf, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return assembly.report_links(d.select(day.alias("date"), F.concat(F.lit("ai-"), "source", F.when(F.col("lang") == "en", "-en").otherwise("")).alias("report_type")))


# scans -----------------------------------------------------------------------------------------------------------
@query("pool_scan", f"WITH {V.SIGNALS_SQL} SELECT strftime(DATE '2024-01-01' + (item_ord % 30)::INT, '%Y-%m-%d') AS date, title, category, score, action FROM v_pool")
def pool_scan(spark, sf):
    """The pool written as dated JSON and read back."""
    at = f"{scratch(spark)}/pool"
    sinks.write_pool_files(_index(spark, sf).withColumn("url", F.lit("")).withColumn("summary", F.lit("")).withColumn("evidence", F.array("source")).drop("item_ord"), at)
    return landed.scan_pool(spark.read, at, multi_line=False).select(F.col("date").cast("string").alias("date"), "title", "category", "score", "action")


@query("report_scan", _R + f", {_NAMED}, one AS (SELECT date, report_type, min(doc_id) AS doc_id FROM v_named WHERE NOT ends_with(report_type, '-en') AND report_type NOT IN ('ai-weekly', 'ai-monthly') GROUP BY ALL) SELECT one.date, one.report_type, md5(content) AS content_md5 FROM one JOIN v_named v ON v.doc_id = one.doc_id")
def report_scan(spark, sf):
    """Report files written under their dates and read back; -en, weekly and monthly ones are passed over."""
    at = f"{scratch(spark)}/reports"
    r = _named_reports(spark, sf)
    sinks.write_reports(r.groupBy("date", "report_type").agg(F.min_by("content", "doc_id").alias("content")), at)
    return landed.scan_report_table(spark, at).select("date", "report_type", F.md5("content").alias("content_md5"))


_BROKEN = "CASE WHEN item_ord % 7 = 0 THEN 'not JSON' WHEN item_ord % 7 = 1 THEN 'no candidates' ELSE 'good' END"


@query("pool_quarantine", _IDX + f", f AS (SELECT DISTINCT strftime(DATE '2024-01-01' + (item_ord % 30)::INT, '%Y-%m-%d') AS date, {_BROKEN} AS state FROM idx) SELECT date, state, count(*) AS files FROM f GROUP BY ALL")
def pool_quarantine(spark, sf):
    """Pool files of each day, a third of them broken: the good ones' dates, and what the others are set aside for."""
    rows = _index(spark, sf)
    state = F.when(F.col("item_ord") % 7 == 0, "not JSON").when(F.col("item_ord") % 7 == 1, "no candidates").otherwise("good")
    pools = rows.select("date", state.alias("state"), F.struct("title", "score").alias("c")).groupBy("date", "state").agg(F.slice(F.sort_array(F.collect_list("c")), 1, 60).alias("candidates"))
    text = F.to_json(F.struct("candidates"))
    value = F.when(F.col("state") == "not JSON", F.substring(text, 1, 40)).when(F.col("state") == "no candidates", F.lit('{"items": []}')).otherwise(text)
    at = f"{scratch(spark)}/pools"
    pools.select("date", "state", value.alias("value")).repartition("date", "state").write.partitionBy("date", "state").text(at)
    bad = landed.quarantined_pools(spark.read, at, multi_line=False)
    good = landed.scan_pool(spark.read, at, multi_line=False).select(F.col("date").cast("string").alias("date"), "state").distinct()
    day = F.regexp_extract("path", "date=([0-9-]+)", 1)
    return good.select("date", "state").unionByName(bad.select(day.alias("date"), F.col("reason").alias("state"))).groupBy("date", "state").agg(F.count("*").alias("files"))


@query("state_table_stored", _M + " SELECT site, url, coalesce(lastmod, 'seen') AS lastmod FROM v_site WHERE site = 'site1'")
def state_table_stored(spark, sf):
    """The crawl state after a crawl, written as a table clustered by its key and asked for one site."""
    found, at = V.sitemap(spark, sf).select("site", "url", "lastmod"), f"{scratch(spark)}/state"
    sinks.write_table(crawl.next_state(found, V.crawl_state(spark, sf)), at, ("site", "url"))
    return spark.read.parquet(at).filter("site = 'site1'")


# streams ---------------------------------------------------------------------------------------------------------
BATCHES = 3


def _stream(spark, sf, name):
    """The driver's table as a stream of ``BATCHES`` triggers, each of as many files as tasks would scan its share."""
    rows, at = table(spark, sf, name), f"{scratch(spark)}/{name}"
    each = -(-rows.rdd.getNumPartitions() // BATCHES)
    rows.repartition(BATCHES * each).write.parquet(at)
    return streams.read_files(spark, at, rows.schema, each)


@query("stream_kg_topics", _A + f"SELECT topic_id, name, category, total_score, mention_count, first_seen, last_seen FROM {_TOPICS}")
def stream_kg_topics(spark, sf):
    app, at = V.appearances(spark, sf, read=_stream), scratch(spark)
    streams.merge_topics(app, f"{at}/topics", f"{at}/checkpoint").start().awaitTermination()
    return tables.current(spark, f"{at}/topics").drop("ord")


@query("stream_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    rows, at = _stream(spark, sf, "events").select("user_id", "event_type", "ts"), scratch(spark)
    streams.first_of_key(rows, ["user_id", "event_type"], f"{at}/rows", f"{at}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{at}/rows/batch=*").select("user_id", "event_type")


@query("stream_crawl_diff", _M + """, s AS (SELECT * FROM v_state), f AS (SELECT * FROM v_site) SELECT f.page_id, f.site, f.lastmod FROM f LEFT JOIN s ON s.site = f.site AND s.url = f.url
WHERE s.url IS NULL OR (f.site <> 'site1' AND f.lastmod > s.lastmod)""")
def stream_crawl_diff(spark, sf):
    """New and changed URLs of a crawl that comes in batches, against the stored state, which each batch renews."""
    found, at = V.sitemap(spark, sf, read=_stream).select("page_id", "site", "url", "lastmod"), scratch(spark)
    state = V.crawl_state(spark, sf).unionByName(spark.range(1).select(F.lit("site2").alias("site"), F.lit("known").alias("url"), F.lit("seen").alias("lastmod")))
    streams.crawl_diffs(found, state, f"{at}/crawl", f"{at}/checkpoint", ("site1",)).start().awaitTermination()
    return spark.read.parquet(f"{at}/crawl/new/batch=*").select("page_id", "site", "lastmod")


@query("stream_crawl_state", _M + " SELECT coalesce(f.site, s.site) AS site, coalesce(f.url, s.url) AS url, CASE WHEN f.url IS NULL THEN s.lastmod ELSE coalesce(f.lastmod, 'seen') END AS lastmod FROM v_site f FULL JOIN v_state s ON s.site = f.site AND s.url = f.url")
def stream_crawl_state(spark, sf):
    """All URLs with their lastmod, read from the state store after a crawl in batches."""
    found, at = V.sitemap(spark, sf, read=_stream).select("page_id", "site", "url", "lastmod"), scratch(spark)
    streams.crawl_diffs(found, V.crawl_state(spark, sf), f"{at}/crawl", f"{at}/checkpoint", ("site1",)).start().awaitTermination()
    return streams.crawl_state(spark, f"{at}/checkpoint")


@query("stream_score", f"WITH {V.SIGNALS_SQL} SELECT item_ord, category, score, action FROM v_pool")
def stream_score(spark, sf):
    signals, at = V.signals(spark, sf, read=_stream), scratch(spark)
    scored = streams.score_stream(signals, V.now(), RULES).select("item_ord", "category", "score", "action")
    streams.upsert_sink(scored, ["item_ord"], f"{at}/rows", f"{at}/checkpoint").start().awaitTermination()
    return tables.current(spark, f"{at}/rows")


@query("stream_daily_top", f"""WITH {V.SIGNALS_SQL} SELECT day, rank, title, score FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, src_ord, item_ord)::INT AS rank
  FROM (SELECT *, strftime(DATE '2024-01-01' + (item_ord % 5)::INT, '%Y-%m-%d') AS day FROM v_pool)) WHERE rank <= 60""")
def stream_daily_top(spark, sf):
    """The best 60 of each day of event time, kept up to date as signals come in."""
    ts = F.timestamp_add("DAY", (F.col("item_ord") % 5).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    signals, at = V.signals(spark, sf, read=_stream).withColumn("ts", ts), scratch(spark)
    streams.daily_top(streams.score_stream(signals, V.now(), RULES), f"{at}/top", f"{at}/checkpoint", keep=("title",), late_days=30).start().awaitTermination()
    return tables.current(spark, f"{at}/top").select("day", "rank", "title", "score")


@query("stream_dedup_watermark", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup_watermark(spark, sf):
    """The same within a watermark, which here covers all of the events' time."""
    rows, at = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), scratch(spark)
    out = streams.dedup_stream(rows, ["user_id", "event_type"], late="400 days")
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("user_id", "event_type")
