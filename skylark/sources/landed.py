"""Landed payloads to typed rows: JSON, XML and HTML read as text columns, parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities, squeeze, strip_html

PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def tag(block: Column, name: str) -> Column:
    """Text of the first <name>, out of CDATA if it is in one; null when absent."""
    body = F.nullif(F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), F.lit(""))
    return F.regexp_replace(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")


def blocks(value: Column, name: str) -> Column:
    return F.regexp_extract_all(value, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}>"), F.lit(0))


def _place(feeds: DataFrame) -> Column:
    return (F.col("item_ord").cast("long") if "item_ord" in feeds.columns else F.lit(0).cast("long")).alias("_feed")


def _ord() -> Column:
    return (F.col("_feed") * 1_000_000 + F.col("_i")).alias("item_ord")


def rss_items(feeds: DataFrame, value: str = "value", author: tuple[str, ...] = ("dc:creator", "author"), limit: int = 500, trim: bool = True) -> DataFrame:
    """(item_ord, title, link, guid, author, description, summary, published_at) of items with a title and a link; guid
    falls back to it. item_ord is the place in the feed, after the feed's own item_ord if it has one."""
    b = F.col("_b")
    title = F.trim(tag(b, "title")) if trim else tag(b, "title")
    out = feeds.select(_place(feeds), F.posexplode(blocks(F.col(value), "item")).alias("_i", "_b"))
    out = out.select(_ord(), title.alias("title"), F.trim(tag(b, "link")).alias("link"), tag(b, "guid").alias("guid"), F.coalesce(*[tag(b, a) for a in author], F.lit("")).alias("author"), F.coalesce(tag(b, "description"), F.lit("")).alias("description"), strip_html(F.coalesce(tag(b, "description"), F.lit("")), limit).alias("summary"), tag(b, "pubDate").alias("published_at"))
    return out.filter((F.trim("title") != "") & (F.col("link") != "")).withColumn("guid", F.coalesce("guid", "link"))


def atom_entries(feeds: DataFrame, value: str = "value") -> DataFrame:
    """Paper entries; the pdf link falls back to the abstract link with /pdf/."""
    b = F.col("_b")
    out = feeds.select(_place(feeds), F.posexplode(blocks(F.col(value), "entry")).alias("_i", "_b"))
    link = F.nullif(F.regexp_extract(b, r'(?is)<link[^>]*rel="alternate"[^>]*href="([^"]*)"', 1), F.lit(""))
    pdf = F.nullif(F.regexp_extract(b, r'(?is)<link[^>]*title="pdf"[^>]*href="([^"]*)"', 1), F.lit(""))
    return out.select(
        _ord(), F.trim(tag(b, "id")).alias("id"), squeeze(tag(b, "title")).alias("title"), squeeze(tag(b, "summary")).alias("summary"),
        F.regexp_extract_all(b, F.lit(r"(?is)<name>\s*([^<]*?)\s*</name>"), F.lit(1)).alias("authors"),
        F.regexp_extract_all(b, F.lit(r'(?is)<category[^>]*term="([^"]*)"'), F.lit(1)).alias("categories"),
        tag(b, "published").alias("published"), tag(b, "updated").alias("updated"), F.coalesce(link, F.trim(tag(b, "id"))).alias("url"),
        F.coalesce(pdf, F.replace(F.coalesce(link, F.trim(tag(b, "id"))), F.lit("/abs/"), F.lit("/pdf/"))).alias("pdf_url"),
    ).filter(F.col("id") != "")


def sitemap_urls(maps: DataFrame, value: str = "value") -> DataFrame:
    """(…, url, lastmod) of every <url> block with a location."""
    b = F.col("_b")
    rest = [c for c in maps.columns if c != value]
    out = maps.select(*rest, F.explode(blocks(F.col(value), "url")).alias("_b"))
    return out.select(*rest, decode_entities(F.trim(tag(b, "loc"))).alias("url"), F.trim(tag(b, "lastmod")).alias("lastmod")).filter("url IS NOT NULL AND url <> ''")


def is_sitemap_index(value: Column) -> Column:
    return F.contains(F.lower(value), F.lit("<sitemapindex"))


def trending_blocks(pages: DataFrame, value: str = "value") -> DataFrame:
    """Repository rows of a trending page: a block starts at each row article; blocks without a name are skipped."""
    parts = F.split(F.col(value), r'(?i)<article[^>]*class="[^"]*Box-row[^"]*"')
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    b = F.col("_b")
    number = lambda pattern: F.regexp_replace(F.nullif(F.regexp_extract(b, pattern, 1), F.lit("")), ",", "").cast("int")
    return pages.select(_place(pages), F.posexplode(parts).alias("_i", "_b")).select(
        _ord(),
        F.regexp_extract(b, r'(?is)<h2[^>]*>.*?<a[^>]+href="/([^/"]+/[^/"]+)"', 1).alias("full_name"),
        squeeze(strip_html(F.regexp_extract(b, r'(?is)<p[^>]*class="[^"]*col-9[^"]*"[^>]*>(.*?)</p>', 1))).alias("description"),
        F.trim(F.regexp_extract(b, r'(?is)itemprop="programmingLanguage">([^<]*)<', 1)).alias("language"),
        F.coalesce(number(r"([\d,]+)\s+stars today"), F.lit(0)).alias("today_stars"),
        F.coalesce(number(r'(?is)href="/[^"]+/stargazers"[^>]*>(?:\s*<svg.*?</svg>)?\s*([\d,]+)'), F.lit(0)).alias("total_stars"),
        F.coalesce(number(r'(?is)href="/[^"]+/forks"[^>]*>(?:\s*<svg.*?</svg>)?\s*([\d,]+)'), F.lit(0)).alias("forks"),
    ).filter("full_name <> ''")


def scan_json(reader: DataFrameReader, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Per-date JSON under date= folders; corrupt files give no rows, missing dates none either. Without ``multi_line``
    a file holds one document a line."""
    rows = reader.options(**PERMISSIVE, multiLine=multi_line).schema(f"{schema}, _corrupt_record string").json(path)
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


_CANDIDATES = "array<struct<title:string,topic:string,url:string,source:string,category:string,score:int,action:string,reason:string,summary:string,evidence:array<string>>>"


def quarantined_json(reader: DataFrameReader, path: str, schema: str, needs: dict[str, str], multi_line: bool = True) -> DataFrame:
    """(path, reason) of the JSON files under ``path`` that are set aside: those that are no JSON, and those without one of
    the columns in ``needs``, with the reason for each. ``scan_json`` reads the others."""
    rows = reader.options(**PERMISSIVE, multiLine=multi_line).schema(f"{schema}, _corrupt_record string").json(path)
    reason = F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
    for column, why in needs.items():
        reason = reason.when(F.col(column).isNull(), why)
    return rows.select(F.input_file_name().alias("path"), reason.alias("reason"), *needs, "_corrupt_record").filter("reason IS NOT NULL").select("path", "reason").distinct()


def quarantined_pools(reader: DataFrameReader, path: str, multi_line: bool = True) -> DataFrame:
    return quarantined_json(reader, path, f"generated_at string, candidates {_CANDIDATES}", {"candidates": "no candidates"}, multi_line)


def quarantined_reports(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, reason) of the report files under ``path`` that are set aside: names without a date, blank files, and files
    that are not UTF-8. Files are read as bytes, for a reader of text would replace what it cannot decode; files without
    any byte are not seen by Spark's readers."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    dated = F.rlike("path", F.lit(r"/(?:date=)?\d{4}-\d{2}-\d{2}/[^/]+(?:/[^/]+)?$"))
    reason = F.when(~dated, "no date").when(F.rlike(F.col("content").cast("string"), F.lit(r"^\s*$")), "blank").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return raw.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def scan_pool(reader: DataFrameReader, path: str, multi_line: bool = True) -> DataFrame:
    """Candidates of the daily pools, one row each; title falls back to topic. Broken files: ``quarantined_pools``."""
    pools = scan_json(reader, path, f"generated_at string, candidates {_CANDIDATES}", multi_line)
    folders = [c for c in pools.columns if c not in ("date", "generated_at", "candidates")]
    return pools.select("date", *folders, F.posexplode("candidates").alias("item_ord", "c")).select("date", *folders, "item_ord", F.coalesce("c.title", "c.topic").alias("title"), *[f"c.{x}" for x in ("url", "source", "category", "score", "action", "reason", "summary", "evidence")])


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """(date, report_type, content) of the daily markdown files <date>/<report>.md, without -en, weekly and monthly."""
    raw = spark.read.text(f"{path}/*/*.md", wholetext=True).select("value", F.input_file_name().alias("f"))
    named = raw.select(F.regexp_extract("f", r"/(?:date=)?(\d{4}-\d{2}-\d{2})/[^/]+$", 1).alias("date"), F.regexp_extract("f", r"/([^/]+)\.md$", 1).alias("report_type"), F.col("value").alias("content"))
    name = F.col("report_type")
    return named.filter((F.col("date") != "") & ~F.endswith(name, F.lit("-en")) & ~F.contains(name, F.lit("weekly")) & ~F.contains(name, F.lit("monthly")))


def scan_report_table(spark: SparkSession, path: str) -> DataFrame:
    """(date, report_type, content) of reports written under date= and report_type= folders, without -en, weekly and
    monthly ones; the folders' names prune the files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("date").cast("string").alias("date"), "report_type", F.regexp_replace("value", r"\n\z", "").alias("content"))
    name = F.col("report_type")
    return rows.filter(~F.endswith(name, F.lit("-en")) & ~F.contains(name, F.lit("weekly")) & ~F.contains(name, F.lit("monthly")))


def source_counts(items: DataFrame, source: str = "source") -> DataFrame:
    """Rows of each source, whether it has any, and the total."""
    counts = items.groupBy(source).agg(F.count("*").alias("n"))
    return counts.select(source, "n", (F.col("n") > 0).alias("has_any"), F.sum("n").over(Window.partitionBy()).alias("total"))
