"""Queries of sources, predicates, scoring, ranking and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import dates as D
from ..functions import text as X
from ..operators import ranking, scoring, signals
from ..operators.assembly import by_score
from ..sources import items
from . import views as V
from .registry import query, table

_S, _P = f"WITH {V.SIGNALS_SQL} ", ["score DESC", "src_ord", "item_ord"]
RULES = R.CORPUS_RULES


def _scored(spark, sf):
    return scoring.score_signals(V.signals(spark, sf), V.now(), RULES)


def _pool(spark, sf):
    return scoring.topic_radar(V.signals(spark, sf), V.now(), RULES)


_TOP60 = "SELECT * FROM v_pool ORDER BY score DESC, src_ord, item_ord LIMIT 60"
_CARD = "title, url, source, category, score, action, angle, reason, recommended_topic, commercial_impact, heat, freshness, writability, array_to_string(evidence, '；') AS evidence"


def _card(df):
    return df.select("title", "url", "source", "category", "score", "action", "angle", "reason", "recommended_topic", "commercial_impact", "heat", "freshness", "writability", F.array_join("evidence", "；").alias("evidence"))


@query("topic_radar", _S + f"SELECT {_CARD} FROM ({_TOP60})")
def topic_radar(spark, sf):
    return _card(_pool(spark, sf))


def _any_of(words, text):
    return V._any([w.lower() for w in words], text)


_NAME = "source || '/' || doc_id"
_UNION = f"""d AS (SELECT *, left(text, 60) AS t60, doc_id % 10 AS k, 'https://example.org/' || doc_id AS u FROM documents), e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
u AS (
  SELECT 0 AS src_ord, doc_id AS item_ord, {_NAME} AS title, u AS url, 'GitHub Trending' AS source, 'github' AS source_type, text AS summary, NULL AS published_at, (doc_id % 50) || ',' || n_chars AS heat, lang AS tags FROM d WHERE k = 0
  UNION ALL SELECT 1, min(doc_id), {_NAME.replace("doc_id", "(doc_id // 40)")}, 'https://example.org/' || min(doc_id), 'GitHub Search:q' || (min(doc_id) % 6), 'github', arg_min(CASE WHEN doc_id % 20 = 1 THEN '' ELSE text END, doc_id), '2024-01-20T00:00:00Z', arg_min(n_chars, doc_id)::VARCHAR,
    arg_min(CASE WHEN doc_id % 30 = 1 THEN '' ELSE lang || ',' END, doc_id) || 'q' || (min(doc_id) % 6) FROM d WHERE k = 1 GROUP BY source, doc_id // 40
  UNION ALL SELECT 2, event_id, event_type || '-' || user_id, CASE WHEN event_id % 4 = 0 THEN 'https://news.ycombinator.com/item?id=' || user_id || event_type ELSE 'https://example.org/e' || event_id END, 'Hacker News', 'community', 'HN discussion by u' || user_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z'), floor(value)::INT || ',' || CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 100 END, 'community,discussion' FROM e WHERE n = 1
  UNION ALL SELECT 3, doc_id, t60, CASE WHEN doc_id % 20 = 2 THEN u ELSE u || '/site' END, 'Product Hunt', 'product', left(text, 100), '2024-01-31', n_chars || ',' || doc_id % 7, lang || ',AI' FROM d WHERE k = 2 AND doc_id % 3 <> 0
  UNION ALL SELECT 4, doc_id, t60, u, 'ArXiv', 'research', text, '2024-01-30', '', lang || ',' || source FROM d WHERE k = 3
  UNION ALL SELECT 5, doc_id, {_NAME}, 'https://huggingface.co/' || {_NAME}, 'Hugging Face', 'model', CASE WHEN doc_id % 20 = 4 THEN '' ELSE lang END || ' model by ' || source, '', n_chars || ',' || doc_id % 1000, concat_ws(',', nullif(CASE WHEN doc_id % 20 = 4 THEN '' ELSE lang END, ''), CASE WHEN doc_id % 3 = 0 THEN source END) FROM d WHERE k = 4
  UNION ALL SELECT 6, page_id, url, url, 'Site ' || (page_id % 3), 'official', left(html, 80), NULL, '', 'site' || (page_id % 3) || ',article' FROM pages
  UNION ALL SELECT 7, doc_id, t60, u, '36kr', 'community', text, '2024-01-31', '', '36kr,中国AI' FROM d WHERE k = 5 AND {_any_of(R.NEWS_KEYWORDS, "lower(t60 || ' ' || text)")}
  UNION ALL SELECT 8, doc_id, t60, CASE WHEN doc_id % 20 = 6 THEN 'https://www.infoq.cn/article/x' || doc_id ELSE u END, 'InfoQ 中国', 'community', left(text, 500), '2024-01-01T00:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || '.000Z', '', 'infoq-cn,' || lang FROM d WHERE k = 6 AND {_any_of(R.ARTICLE_KEYWORDS, "lower(t60 || ' ' || text || ' ' || lang)")}
  UNION ALL SELECT 9, doc_id, {_NAME}, u, 'Gitee', 'github', CASE WHEN doc_id % 20 = 7 THEN '' ELSE text END, '2024-01-31', n_chars || ',' || doc_id % 9, 'gitee,' || lang FROM d WHERE k = 7 AND {_any_of(R.PROJECT_KEYWORDS, "lower(source || ' ' || CASE WHEN doc_id % 20 = 7 THEN '' ELSE text END)")}
  UNION ALL SELECT 10, doc_id, t60, u, '开源中国', 'community', text, '2024-01-31', '', 'oschina,中国AI' FROM d WHERE k = 8 AND {_any_of(R.PROJECT_NEWS_KEYWORDS, "lower(t60 || ' ' || text)")}
  UNION ALL SELECT 11, doc_id, t60, 'https://juejin.cn/post/' || doc_id, '掘金', 'community', left(text, 500), '2024-01-01T00:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || '.000Z', n_chars || ',' || doc_id % 11, 'juejin,' || lang FROM d WHERE k = 9)"""


@query("signals_union", f"WITH {_UNION} SELECT src_ord, item_ord, title, url, source, source_type, md5(summary) AS summary_md5, published_at, heat, tags FROM u")
def signals_union(spark, sf):
    """All twelve inputs, landed rows made of the tables, through their normalisers (without cuts) and the union."""
    s = signals.normalize_signals(_inputs(spark, sf))
    shown = F.array_join(F.transform("heat_signals", lambda h: h.cast("long").cast("string")), ",")
    return s.select("src_ord", "item_ord", "title", "url", "source", "source_type", F.md5("summary").alias("summary_md5"), "published_at", shown.alias("heat"), F.array_join("tags", ",").alias("tags"))


def _inputs(spark, sf):
    n, lang, source, text = (F.col(c) for c in ("doc_id", "lang", "source", "text"))
    d = table(spark, sf, "documents").select("*", n.alias("item_ord"), F.substring("text", 1, 60).alias("title"), F.concat(F.lit("https://example.org/"), n.cast("string")).alias("url"), F.concat(source, F.lit("/"), n.cast("string")).alias("name"))
    kind, no = lambda k: d.filter(n % 10 == k), F.lit(None).cast("string")
    unless = lambda m, k, x: F.when(n % m != k, x)
    node = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    e = table(spark, sf, "events")
    p = table(spark, sf, "pages")
    site = (F.col("page_id") % 3).cast("string")
    topic = lambda slug, name: node(node=node(slug=slug, name=name))
    return {
        "trending": kind(0).select("item_ord", F.col("name").alias("full_name"), "url", text.alias("description"), lang.alias("language"), (n % 50).alias("today_stars"), F.col("n_chars").alias("total_stars")),
        "search": items.search_repos(kind(1).select("item_ord", F.concat(source, F.lit("/"), F.floor(n / 40).cast("string")).alias("full_name"), unless(20, 1, text).alias("description"), unless(30, 1, lang).alias("language"), F.col("n_chars").alias("stargazers_count"), F.lit("2024-01-20T00:00:00Z").alias("pushed_at"), F.col("url").alias("html_url"), F.concat(F.lit("q"), (n % 6).cast("string")).alias("search_query"))),
        "stories": items.stories(e.select(F.col("event_id").alias("item_ord"), F.concat(F.col("user_id").cast("string"), "event_type").alias("id"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("title"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("https://example.org/e"), F.col("event_id").cast("string"))).alias("url"), F.floor("value").alias("points"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100).alias("num_comments"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("created_at")), limit=None),
        "products": items.products(kind(2).select("item_ord", node(id=n, name=F.col("title"), tagline=F.substring("text", 1, 100), url=F.col("url"), website=F.when(n % 20 != 2, F.concat("url", F.lit("/site"))).otherwise(""), votes_count=F.col("n_chars"), comments_count=n % 7, created_at=F.lit("2024-01-31"), topics=node(edges=F.array(topic(lang, lang), topic(F.when(n % 3 != 0, "llm").otherwise("games"), F.lit("AI"))))).alias("node")), limit=None),
        "papers": kind(3).select("item_ord", "title", "url", text.alias("summary"), F.lit("2024-01-30").alias("published"), F.array(lang, source).alias("categories")),
        "models": items.models(kind(4).select("item_ord", F.col("name").alias("id"), no.alias("author"), F.col("n_chars").alias("likes"), (n % 1000).alias("downloads"), F.when(n % 3 == 0, F.array(source)).alias("tags"), unless(20, 4, lang).alias("pipeline_tag"), no.alias("last_modified"))),
        "official": p.select(F.col("page_id").alias("item_ord"), F.col("url").alias("title"), "url", F.substring("html", 1, 80).alias("content"), no.alias("lastmod"), F.concat(F.lit("Site "), site).alias("site_name"), F.concat(F.lit("site"), site).alias("site"), F.lit("article").alias("category")),
        "news": items.about(kind(5).select("item_ord", "title", "url", text.alias("summary"), F.lit("2024-01-31").alias("published_at")), R.NEWS_KEYWORDS, "title", "summary"),
        "topic_articles": items.topic_articles(kind(6).select("item_ord", n.alias("id"), F.concat(F.lit("x"), n.cast("string")).alias("uuid"), "title", unless(20, 6, F.col("url")).alias("url"), text.alias("description"), F.lit(None).cast("struct<name:string,nickname:string>").alias("author"), (F.lit(1704067200) + n % 60).alias("publish_time"), F.array(lang).alias("topics")), limit=None),
        "projects": items.projects(kind(7).select("item_ord", n.alias("id"), source.alias("name"), F.col("name").alias("full_name"), F.col("url").alias("html_url"), unless(20, 7, text).alias("description"), lang.alias("language"), F.col("n_chars").alias("stargazers_count"), (n % 9).alias("forks_count"), F.lit("2024-01-31").alias("updated_at"), node(path=source).alias("namespace")), limit=None),
        "project_news": items.about(kind(8).select("item_ord", "title", "url", text.alias("summary"), F.lit("2024-01-31").alias("published_at")), R.PROJECT_NEWS_KEYWORDS, "title", "summary"),
        "hot_articles": items.hot_articles(kind(9).select("item_ord", n.cast("string").alias("article_id"), node(title=F.col("title"), brief_content=text, digg_count=F.col("n_chars"), view_count=n % 11, publish_time=F.lit(1704067200) + n % 60).alias("article_info"), node(user_name=source).alias("author_user_info"), F.array(node(tag_name=lang)).alias("tags")), limit=None),
    }


@query("has_any_keyword", f"SELECT doc_id, {V._any(RULES.policy, 'lower(text)')} AS policy, {V._any(RULES.enterprise, 'lower(text)')} AS enterprise FROM documents")
def has_any_keyword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_any(F.col("text"), RULES.policy).alias("policy"), X.has_any(F.col("text"), RULES.enterprise).alias("enterprise"))


def _scored_query(name, *columns):
    @query(name, _S + f"SELECT item_ord, {', '.join(columns)} FROM v_pool")
    def run(spark, sf):
        return _scored(spark, sf).select("item_ord", *columns)


_scored_query("classify", "source_type", "category")
_scored_query("heat_score", "heat")
_scored_query("freshness_score", "freshness")
_scored_query("commercial_score", "commercial_impact")
_scored_query("writability_score", "writability")
_scored_query("action_band", "score", "action")
_scored_query("reason_text", "reason", "recommended_topic", "angle")


@query("evidence", _S + "SELECT item_ord, unnest(evidence) AS item, unnest(range(len(evidence)))::INT AS pos FROM v_pool")
def evidence(spark, sf):
    return _scored(spark, sf).select("item_ord", F.posexplode("evidence").alias("pos", "item"))


_EXPECTED = [("src0", "src0", "src0 获取失败"), ("src1", "src1", "src1 获取失败"), ("nowhere", "nowhere", "nowhere 获取失败"), ("official-a", "official", "官方内容源今日没有检测到新内容"), ("official-b", "official", "官方内容源今日没有检测到新内容")]


@query("source_warnings", "WITH e(source, g, message) AS (VALUES " + ", ".join(str(x) for x in _EXPECTED) + """)
SELECT min(e.source) AS source, min(message) AS message FROM e LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) c ON c.source = e.source GROUP BY g HAVING sum(coalesce(n, 0)) = 0""")
def source_warnings(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return scoring.source_warnings(counts, spark.createDataFrame(_EXPECTED, "source string, group string, message string"))


@query("sections_by_action", _S + f""", top AS ({_TOP60}), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY score DESC, src_ord, item_ord)::INT AS rank FROM top)
SELECT action, rank, title, score FROM r WHERE rank <= CASE action WHEN '深挖' THEN 10 WHEN '入池' THEN 15 WHEN '观察' THEN 15 ELSE 0 END""")
def sections_by_action(spark, sf):
    return ranking.top_per_group(_pool(spark, sf), "action", {"深挖": 10, "入池": 15, "观察": 15}, by_score()).select("action", "rank", "title", "score")


@query("sections_by_category", _S + f""", top AS ({_TOP60}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, src_ord, item_ord)::INT AS rank FROM top)
SELECT category, rank, title, score FROM r WHERE rank <= 5""")
def sections_by_category(spark, sf):
    return ranking.top_per_group(_pool(spark, sf), "category", 5, by_score()).select("category", "rank", "title", "score")


@query("report_markdown", _S + f""", top AS ({_TOP60}), rows_ AS (
SELECT action, row_number() OVER (PARTITION BY action ORDER BY score DESC, src_ord, item_ord) AS n, '| ' || score || ' | ' || action || ' | [' || replace(replace(title, '|', '\\|'), chr(10), '<br>') || '](' || url || ') | ' || category || ' | '
  || replace(replace(recommended_topic, '|', '\\|'), chr(10), '<br>') || ' | ' || reason || ' | ' || array_to_string(evidence, '<br>') || ' |' AS line FROM top)
SELECT a.action, coalesce(string_agg(line, chr(10) ORDER BY n), '_暂无条目。_') AS body FROM (VALUES ('深挖'), ('入池'), ('观察')) a(action) LEFT JOIN rows_ ON rows_.action = a.action GROUP BY a.action""")
def report_markdown(spark, sf):
    from ..operators.assembly import section_tables

    return section_tables(_pool(spark, sf), ("深挖", "入池", "观察"))


@query("dedup_first", """SELECT doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return ranking.keep_first(d, ["text_md5"], ["doc_id"])


@query("topn_global", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def topn_global(spark, sf):
    return ranking.top_n(table(spark, sf, "documents").select("doc_id", "n_chars"), 30, F.desc("n_chars"), "doc_id")


_LAST = "(SELECT max(ts) FROM events)"


@query("recent_window", f"SELECT event_id, ts, event_type FROM events WHERE ts > {_LAST} - INTERVAL 24 HOURS AND ts <= {_LAST}")
def recent_window(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return ranking.recent(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]))


@query("stale_items", f"WITH {V.REPO_SQL} SELECT number, repo, created_at FROM v_items WHERE state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAYS")
def stale_items(spark, sf):
    return ranking.stale(V.repo_items(spark, sf), F.lit("1998-01-01").cast("timestamp"), 365).select("number", "repo", "created_at")


_PATH = "CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) END"


@query("url_prefix_filter", f"SELECT page_id, url FROM pages WHERE starts_with({_PATH}, '/en/') OR starts_with({_PATH}, '/de/1')")
def url_prefix_filter(spark, sf):
    return table(spark, sf, "pages").filter(X.has_path_prefix(F.col("url"), ("/en/", "/de/1"))).select("page_id", "url")


@query("url_category", f"SELECT page_id, coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[1], 'article') AS category FROM pages")
def url_category(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_category(F.col("url")).alias("category"))


@query("url_title", f"""SELECT page_id, array_to_string(list_transform(string_split(replace(coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], ''), '-', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM pages""")
def url_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_title(F.col("url")).alias("title"))


@query("page_title", "SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]{1,200})</title>', 1)) AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))


def _decoded(x):
    for a, b in X.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return x


_ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace({_ARTICLE}, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query("page_text", f"SELECT page_id, left(trim(regexp_replace({_decoded(_PLAIN)}, '\\s+', ' ', 'g')), 1500) AS body FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.page_text(F.col("html")).alias("body"))


@query("strip_html", "SELECT page_id, left({}, 500) AS body FROM pages".format(_decoded("regexp_replace(html, '<[^>]*>', '', 'g')")))
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


@query("escape_text", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS xml_md5, md5(replace(replace(html, '|', '\\|'), chr(10), '<br>')) AS cell_md5 FROM pages")
def escape_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape_xml(F.col("html"))).alias("xml_md5"), F.md5(X.escape_cell(F.col("html"))).alias("cell_md5"))


@query("truncate_notice", "SELECT doc_id, md5(CASE WHEN len(text) > 2500 THEN left(text, 2500) || '...' ELSE text END) AS cut_md5 FROM documents")
def truncate_notice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncated(F.col("text"), 2500)).alias("cut_md5"))


@query("neutralize_refs", "SELECT doc_id, md5(regexp_replace(text, '@([A-Za-z0-9])', '@​\\1', 'g')) AS safe_md5 FROM documents")
def neutralize_refs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.neutralize_refs(F.col("text"))).alias("safe_md5"))


@query("extract_keywords", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\s-]', ' ', 'g'), '\\s+'), lambda w: len(w) >= 2))), ' ') AS keywords FROM conversations""")
def extract_keywords(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(X.extract_keywords(F.col("text"))), " ").alias("keywords"))


@query("date_keys", "SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc, strftime(ts, '%G-W%V') AS week FROM events")
def date_keys(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", D.business_date(ts).alias("day"), D.minute_utc(ts).alias("minute"), D.rfc822(ts).alias("rfc"), D.iso_week(ts).alias("week"))


_ITEM = """'#' || number || ' [' || upper(state) || ']' || labels || ' ' || title || chr(10) || '  Author: ' || login || ' | Created: ' || strftime(created_at, '%Y-%m-%d') || ' | Updated: ' || strftime(updated_at, '%Y-%m-%d')
  || ' | Comments: ' || comments || ' | 👍: ' || thumbs || chr(10) || '  URL: org/' || repo || CASE WHEN is_pr THEN ' PR #' ELSE ' Issue #' END || number || chr(10)
  || '  Summary: ' || left(trim(replace(body, chr(10), ' ')), 300) || CASE WHEN len(body) > 300 THEN '...' ELSE '' END"""


@query("format_item", f"WITH {V.REPO_SQL} SELECT number, {_ITEM} AS line FROM v_items")
def format_item(spark, sf):
    from ..operators.assembly import format_repo_item

    return V.repo_items(spark, sf).select("number", format_repo_item("en").alias("line"))


@query("entity_type", f"""SELECT DISTINCT tag, CASE WHEN tag IN ('click', 'u1') THEN 'company' WHEN contains(tag, 'u2') OR contains(tag, 'ie') THEN 'technology' WHEN contains(tag, 'u') THEN 'project' ELSE 'topic_tag' END AS kind
FROM (SELECT unnest([event_type, 'u' || (user_id % 30)]) AS tag FROM events)""")
def entity_type(spark, sf):
    tags = V.appearances(spark, sf).select(F.explode("tags").alias("tag")).distinct()
    return tags.select("tag", X.entity_type(F.col("tag"), ("click", "u1"), ("u2", "ie"), ("u",)).alias("kind"))


_HEAD, _META = r"(?m)^\s*(?:#{1,6}\s*)?\S*rea\b", (r"^\s*$", r"^The\b.*$")


@query("sanitize_summary", r"""WITH c AS (SELECT doc_id, trim(replace(text, chr(13) || chr(10), chr(10))) AS t FROM documents),
h AS (SELECT *, regexp_extract(t, '\A(?s:(.*?))(?m:^\s*(?:#{1,6}\s*)?\S*rea\b)', 1) AS before, regexp_matches(t, '(?m:^\s*(?:#{1,6}\s*)?\S*rea\b)') AS headed, string_split(t, chr(10)) AS lines FROM c),
m AS (SELECT *, list_transform(lines, lambda x: regexp_matches(x, '^\s*$|^The\b.*$')) AS meta FROM h)
SELECT doc_id, md5(trim(CASE WHEN headed THEN substring(t, len(before) + 1) ELSE array_to_string(lines[coalesce(nullif(list_position(meta, false), 0), len(lines) + 1) :], chr(10)) END)) AS clean_md5 FROM m""")
def sanitize_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.sanitize_summary(F.col("text"), _HEAD, _META)).alias("clean_md5"))


@query("fenced_json", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def fenced_json(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.from_json(X.fenced_json(fenced), "k int")["k"].alias("k"))


@query("src_topn_dedup", "SELECT id, event_id, value FROM (SELECT user_id AS id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase')) WHERE n = 1 ORDER BY value DESC, id LIMIT 30")
def src_topn_dedup(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    hits = e.select(F.col("event_id").alias("item_ord"), F.col("user_id").alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("value").alias("points"), F.lit(0).alias("num_comments"), F.lit("a").alias("author"), F.lit("").alias("created_at"))
    return items.stories(hits, limit=30).select("id", F.col("item_ord").alias("event_id"), F.col("points").alias("value"))


@query("src_nested_slug_filter", "SELECT event_id, value FROM events WHERE list_has_any([event_type, 'u' || (user_id % 30)], ['purchase', 'u3', 'u7']) ORDER BY value DESC, event_id LIMIT 30")
def src_nested_slug_filter(spark, sf):
    edge = lambda slug: F.struct(F.struct(slug.alias("slug"), slug.alias("name")).alias("node"))
    topics = F.struct(F.array(edge(F.col("event_type")), edge(F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")))).alias("edges"))
    node = F.struct(F.col("event_id").alias("id"), F.lit("n").alias("name"), F.lit("t").alias("tagline"), F.lit("u").alias("url"), F.lit("").alias("website"), F.col("value").alias("votes_count"), F.lit(0).alias("comments_count"), F.lit("").alias("created_at"), topics.alias("topics"))
    edges = table(spark, sf, "events").select(F.col("event_id").alias("item_ord"), node.alias("node"))
    return items.products(edges, slugs=("purchase", "u3", "u7")).select(F.col("id").alias("event_id"), F.col("votes_count").alias("value"))


@query("src_default_fields", "SELECT p_partkey, coalesce(nullif(CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END, ''), 'unknown') AS author, coalesce(nullif(p_brand, ''), 'none') AS pipeline FROM part")
def src_default_fields(spark, sf):
    name = F.when(F.contains("p_name", F.lit(" ")), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item_ord"), F.concat(F.nullif(name, F.lit("")), F.lit("/x")).alias("id"), F.lit(None).cast("string").alias("author"), F.lit(0).alias("likes"), F.lit(0).alias("downloads"), F.lit(None).cast("array<string>").alias("tags"), F.nullif(F.col("p_brand"), F.lit("")).alias("pipeline_tag"), F.lit(None).cast("string").alias("last_modified"))
    return items.models(rows).select(F.col("item_ord").alias("p_partkey"), "author", F.coalesce(F.nullif(F.col("pipeline_tag"), F.lit("")), F.lit("none")).alias("pipeline"))


@query("src_keyword_filter", f"SELECT doc_id, source FROM documents WHERE {V._any(RULES.policy + RULES.model, 'lower(text)')} ORDER BY doc_id LIMIT 30")
def src_keyword_filter(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_ord"), F.col("doc_id").alias("id"), F.lit("x").alias("uuid"), F.lit("").alias("title"), F.lit("u").alias("url"), F.col("text").alias("description"), F.struct(F.lit("").alias("name"), F.col("source").alias("nickname")).alias("author"), F.lit(0).alias("publish_time"), F.lit(None).cast("array<string>").alias("topics"))
    return items.topic_articles(d, keywords=RULES.policy + RULES.model, limit=30).select(F.col("item_ord").alias("doc_id"), F.col("author").alias("source"))


@query("src_early_cut_then_sort", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderkey LIMIT 30) ORDER BY o_totalprice DESC")
def src_early_cut_then_sort(spark, sf):
    o = table(spark, sf, "orders").filter(F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey", "o_totalprice")
    return ranking.early_cut(o, 30, ["o_orderkey"], [F.desc("o_totalprice"), "o_orderkey"])


@query("src_window_topn", f"SELECT event_id, value FROM events WHERE ts > {_LAST} - INTERVAL 168 HOURS ORDER BY value DESC, event_id LIMIT 20")
def src_window_topn(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    rows = e.select(F.col("event_id").alias("item_ord"), F.col("event_id").alias("short_id"), F.lit("t").alias("title"), F.lit("").alias("url"), F.lit("c").alias("comments_url"), F.col("value").alias("score"), F.lit(0).alias("comment_count"), F.struct(F.lit("u").alias("username")).alias("submitter_user"), F.col("ts").cast("string").alias("created_at"), F.array(F.lit("ai")).alias("tags"))
    return items.community_stories(rows, now).select(F.col("item_ord").alias("event_id"), F.col("score").alias("value"))


@query("repo_recent_items", f"WITH {V.REPO_SQL} SELECT number, repo, is_pr, comments FROM v_items WHERE created_at >= TIMESTAMP '1997-06-01'")
def repo_recent_items(spark, sf):
    rows = V.repo_items(spark, sf).withColumn("updated_at", F.col("created_at").cast("string"))
    return items.recent_items(rows, F.lit("1997-06-01").cast("timestamp"), per_repo=None).select("number", "repo", "is_pr", "comments")


@query("repo_popular_items", f"WITH {V.REPO_SQL} SELECT repo, number, is_pr, comments FROM (SELECT *, row_number() OVER (PARTITION BY repo, is_pr ORDER BY comments DESC, number) AS n FROM v_items WHERE NOT is_pr OR state = 'open') WHERE n <= 50")
def repo_popular_items(spark, sf):
    """Skills repositories: no window, most commented first."""
    return items.popular_items(V.repo_items(spark, sf)).select("repo", "number", "is_pr", "comments")


@query("repo_newest_items", f"WITH {V.REPO_SQL} SELECT repo, number, is_pr FROM (SELECT *, row_number() OVER (PARTITION BY repo, is_pr ORDER BY updated_at DESC, number) AS n FROM v_items WHERE updated_at >= DATE '1996-01-01') WHERE n <= 500")
def repo_newest_items(spark, sf):
    """The page cap: the newest 500 of each repository and kind."""
    rows = V.repo_items(spark, sf).withColumn("updated_at", F.col("updated_at").cast("string"))
    return items.recent_items(rows, F.lit("1996-01-01").cast("timestamp")).select("repo", "number", "is_pr")


@query("source_counts", "SELECT source, count(*) AS n, count(*) > 0 AS has_any, sum(count(*)) OVER ()::BIGINT AS total FROM documents GROUP BY source")
def source_counts(spark, sf):
    from ..sources.landed import source_counts as counts

    return counts(table(spark, sf, "documents"))


@query("src_html_blocks", """SELECT page_id, regexp_extract(html, '<article>\\s*<h1>([^<]*)</h1>', 1) AS name, len(regexp_extract_all(html, '<li>'))::INT AS items FROM pages WHERE regexp_matches(html, '<article>\\s*<h1>[^<]+</h1>')""")
def src_html_blocks(spark, sf):
    h = F.col("html")
    name = F.regexp_extract(h, r"<article>\s*<h1>([^<]*)</h1>", 1)
    return table(spark, sf, "pages").select("page_id", name.alias("name"), F.regexp_count(h, F.lit("<li>")).alias("items")).filter("name <> ''")


@query("src_rss_items", "SELECT doc_id, source AS author, left(regexp_replace(replace(replace(text, '<', ''), '>', ''), '[ \\n]+', ' ', 'g'), 60) AS title FROM documents WHERE trim(left(regexp_replace(replace(replace(text, '<', ''), '>', ''), '[ \\n]+', ' ', 'g'), 60)) <> ''")
def src_rss_items(spark, sf):
    from ..sources.landed import rss_items

    title = F.regexp_replace(F.regexp_replace("text", "[<>]", ""), r"[ \n]+", " ").substr(1, 60)
    item = F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title><link>https://example.org/"), F.col("doc_id").cast("string"), F.lit("</link><author>"), "source", F.lit("</author></item>"))
    feeds = table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(item), "").alias("value"))
    return rss_items(feeds, trim=False).select(F.regexp_extract("link", r"(\d+)$", 1).cast("long").alias("doc_id"), "author", "title")


@query("src_atom_entries", "SELECT doc_id, lang AS category FROM documents")
def src_atom_entries(spark, sf):
    from ..sources.landed import atom_entries

    entry = F.concat(F.lit("<entry><id>"), F.col("doc_id").cast("string"), F.lit('</id><title>t</title><summary> a\n b </summary><category term="'), "lang", F.lit('"/></entry>'))
    feeds = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 500).alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("value"))
    return atom_entries(feeds).select(F.col("id").cast("long").alias("doc_id"), F.get("categories", F.lit(0)).alias("category"))


@query("sitemap_urls", f"WITH {V.SITEMAP_SQL} SELECT url, lastmod FROM v_site")
def sitemap_urls(spark, sf):
    from ..sources.landed import sitemap_urls as urls

    s = V.sitemap(spark, sf)
    block = F.concat(F.lit("<url><loc>"), X.escape_xml(F.col("url")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    maps = s.groupBy("site", F.floor(F.col("page_id") / 600).alias("part")).agg(F.array_join(F.collect_list(block), "\n").alias("value"))
    return urls(maps).select("url", "lastmod")


# whole feeds through their normalisers ---------------------------------------------------------------------------
_PLAIN = "trim(left(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), 60))"


def _plain():
    return F.trim(F.substring(F.regexp_replace("text", "[^A-Za-z0-9]+", " "), 1, 60))


def _feeds(rows, block, size):
    """Blocks of ``size`` documents each, in order of id, as feeds in order."""
    dealt = rows.select(F.floor(F.col("doc_id") / size).alias("item_ord"), F.struct("doc_id", block.alias("b")).alias("x")).groupBy("item_ord")
    return dealt.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("value"))


@query("src_trending_repos", f"""SELECT source || '/r' || doc_id AS full_name, {_PLAIN} AS description, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS language,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id * 13 % 5000 END::INT AS today_stars, n_chars::INT AS total_stars, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id % 900 END::INT AS forks, 'https://github.com/' || source || '/r' || doc_id AS url
FROM documents WHERE doc_id % 9 <> 0""")
def src_trending_repos(spark, sf):
    """Trending pages of 25 repositories, through their normaliser; blocks without a name are passed over."""
    n, name = F.col("doc_id"), F.concat("source", F.lit("/r"), F.col("doc_id").cast("string"))
    some = lambda test, *parts: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    block = F.concat(
        F.lit('<article class="Box-row"><h2 class="h3">'), some(n % 9 != 0, '<a data-x="1" href="/', name, '">x</a>'), F.lit('</h2><p class="col-9 my-1">\n  '), _plain(), F.lit(" \n</p>"),
        some(n % 4 != 0, '<span itemprop="programmingLanguage">', F.col("lang"), "</span>"), F.lit('<a href="/'), name, F.lit('/stargazers"> <svg></svg> '), F.format_number("n_chars", 0), F.lit("</a>"),
        some(n % 6 != 0, '<a href="/', name, '/forks">', F.format_number(n % 900, 0), "</a>"), some(n % 5 != 0, F.format_number(n * 13 % 5000, 0), " stars today"), F.lit("</article>"),
    )
    return items.trending_repos(_feeds(table(spark, sf, "documents"), block, 25)).drop("item_ord")


@query("src_papers", f"""SELECT 'http://e.org/abs/' || doc_id AS id, {_PLAIN} AS title, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [source] ELSE [source, lang] END, ';') AS authors, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS published,
  CASE WHEN doc_id % 2 = 0 THEN 'https://e.org/paper/' || doc_id ELSE 'http://e.org/abs/' || doc_id END AS url, CASE WHEN doc_id % 2 = 0 THEN 'https://e.org/paper/' || doc_id ELSE 'http://e.org/pdf/' || doc_id END AS pdf_url
FROM (SELECT *, TIMESTAMP '{V.NOW_TEXT}' - to_seconds(doc_id * 7919 % 1000003) AS t FROM documents) WHERE t > TIMESTAMP '{V.NOW_TEXT}' - INTERVAL 48 HOURS ORDER BY t DESC LIMIT 50""")
def src_papers(spark, sf):
    """Category feeds that share entries, through their normaliser: each id once, of the last 48 hours, the newest 50."""
    d = table(spark, sf, "documents")
    n, key = F.col("doc_id"), F.col("doc_id").cast("string")
    at = F.date_format(V.now() - F.make_interval(secs=(n * 7919 % 1000003).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    who = lambda c: F.concat(F.lit("<author><name> "), c, F.lit(" </name></author>"))
    block = F.concat(
        F.lit("<entry><id> http://e.org/abs/"), key, F.lit(" </id><title>"), _plain(), F.lit("</title><summary> s </summary>"), who(F.col("source")), F.when(n % 3 != 0, who(F.col("lang"))).otherwise(""),
        F.lit("<published>"), at, F.lit("</published>"), F.when(n % 2 == 0, F.concat(F.lit('<link rel="alternate" href="https://e.org/paper/'), key, F.lit('"/>'))).otherwise(""), F.lit("</entry>"),
    )
    feeds = _feeds(d, block, 200).unionByName(_feeds(d.filter("doc_id % 5 = 0"), block, 300).withColumn("item_ord", F.col("item_ord") + 1_000_000))
    return items.papers(feeds, V.now()).select("id", "title", F.array_join("authors", ";").alias("authors"), "published", "url", "pdf_url")


@query("src_news", f"""SELECT CASE WHEN doc_id % 2 = 1 THEN 'g-' || doc_id ELSE 'https://e.org/' || doc_id END AS id, title, 'https://e.org/' || doc_id AS url, title AS summary, CASE WHEN doc_id % 3 = 0 THEN '36kr' ELSE source END AS author,
  CASE WHEN doc_id % 4 = 0 THEN '2024-02-01' ELSE 'Mon, 0' || (doc_id % 9 + 1) || ' Jan' END AS published FROM (SELECT *, {_PLAIN} AS title FROM documents) WHERE title <> '' AND (contains(lower(title), 'the') OR contains(lower(title), 'ei')) ORDER BY doc_id LIMIT 30""")
def src_news(spark, sf):
    """News feeds through their normaliser: the first 30 about the keywords, with what stands in for missing fields."""
    n, key, title = F.col("doc_id"), F.col("doc_id").cast("string"), _plain()
    some = lambda test, name, value: F.when(test, F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))).otherwise("")
    block = F.concat(
        F.lit("<item><title><![CDATA["), title, F.lit("]]></title><link>https://e.org/"), key, F.lit("</link>"), some(n % 2 == 1, "guid", F.concat(F.lit("g-"), key)), some(n % 3 != 0, "author", F.col("source")),
        some(n % 4 != 0, "pubDate", F.concat(F.lit("Mon, 0"), (n % 9 + 1).cast("string"), F.lit(" Jan"))), F.lit("<description>&lt;b&gt;"), title, F.lit("</description></item>"),
    )
    out = items.news(_feeds(table(spark, sf, "documents"), block, 400), V.now(), ("the", "ei"))
    published = F.when(F.startswith("published_at", F.lit("Mon")), F.col("published_at")).otherwise(F.substring("published_at", 1, 10))
    return out.select("id", "title", "url", F.regexp_replace("summary", "^<b>", "").alias("summary"), "author", published.alias("published"))


@query("src_community_articles", f"""SELECT doc_id AS id, {_PLAIN} AS title, source AS author, n_chars AS reactions, array_to_string([lang, source], ';') AS tags FROM documents WHERE lang IN ('en', 'de') OR doc_id % 3 = 0 ORDER BY n_chars DESC, CASE WHEN lang IN ('en', 'de') THEN 0 ELSE 1 END, doc_id LIMIT 30""")
def src_community_articles(spark, sf):
    """Articles of two tag queries that overlap, through their normaliser: each once, the 30 with most reactions."""
    d = table(spark, sf, "documents")
    row = lambda first: (
        (F.lit(first) + F.col("doc_id")).alias("item_ord"), F.col("doc_id").alias("id"), _plain().alias("title"), F.lit("").alias("description"), F.lit("u").alias("url"), F.lit("").alias("published_at"), F.col("n_chars").alias("positive_reactions_count"),
        F.lit(0).alias("comments_count"), F.lit(1).alias("reading_time_minutes"), F.array("lang", "source").alias("tag_list"), F.struct(F.col("source").alias("name")).alias("user"),
    )
    hits = d.filter("lang IN ('en', 'de')").select(*row(0)).unionByName(d.filter("doc_id % 3 = 0").select(*row(1 << 50)))
    return items.community_articles(hits).select("id", "title", "author", F.col("positive_reactions_count").alias("reactions"), F.array_join("tags", ";").alias("tags"))
