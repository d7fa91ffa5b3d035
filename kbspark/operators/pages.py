"""Page cleaning (C1-C12): crawl tables to cleaned documentation docs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from kbspark.functions import text as T
from kbspark.operators import html_markdown as H

ITEM_SCHEMA = Ty.StructType([
    Ty.StructField("page_id", Ty.LongType()),
    Ty.StructField("url", Ty.StringType()),
    Ty.StructField("title", Ty.StringType()),
    Ty.StructField("hierarchy", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("heading", Ty.StringType()),
    Ty.StructField("content", Ty.StringType()),
])

HREF_PATTERN = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


SCHEME_PATTERN = "^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

#: A document's first sentence of at most so many characters is its title.
TITLE_LENGTH = 100


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME_PATTERN, 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, HOST_PATTERN, 1)


def with_canonical_id(pages: DataFrame) -> DataFrame:
    """C1."""
    return pages.withColumn("canonical_id", T.canonical_url(F.col("url")))


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key, the one with the smallest ``order_col``.

    Uses ``min_by`` so partial aggregation keeps one row per key per map
    task; a key with a huge number of copies never reaches one task whole.
    """
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return agg.select(key, *[F.col("_r")[c].alias(c) for c in cols]).select(*df.columns)


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """C1 + C2: canonical id, first page per id wins (by page_id)."""
    return first_per_key(with_canonical_id(pages), "canonical_id", "page_id")


def resolved(href: Column, url: Column) -> Column:
    """A link's target by the usual rules of relative references; NULL for
    other schemes (mailto and the like)."""
    base = F.regexp_replace(url, "#.*$", "")
    path_base = F.regexp_replace(base, r"\?.*$", "")
    site = F.concat(url_scheme(url), F.lit("://"), url_host(url))
    folder = F.regexp_replace(F.regexp_replace(path_base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    target = F.concat(folder, href)
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_replace(target, "^[^?#]*", "")
    # dot segments: a fold over the parts, '..' takes the part before away
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.array_append(acc, p)))
    ends_dotted = path.rlike(r"/\.\.?$")
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_dotted & (F.size(kept) > 0), "/").otherwise(""))
    return (F.when(href.rlike(SCHEME_PATTERN), href)
            .when(href.startswith("//"), F.concat(url_scheme(url), F.lit(":"), href))
            .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(href == "", base)
            .when(href.startswith("/"), F.concat(site, href))
            .when(href.startswith("?"), F.concat(path_base, href))
            .when(href.startswith("#"), F.concat(base, href))
            .otherwise(F.concat(site, clean, rest)))


def page_links(pages: DataFrame, allowed_domains: list[str] | None = None, allow_pattern: str | None = None) -> DataFrame:
    """(page_id, link_id): the distinct canonical targets of each page's links
    whose host and URL are allowed."""
    found = F.transform(F.regexp_extract_all("html", F.lit(HREF_PATTERN), 1), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    hrefs = pages.select("page_id", "url", F.explode(found).alias("href"))
    links = hrefs.select("page_id", resolved(F.col("href"), F.col("url")).alias("link")).where(F.col("link").isNotNull())
    if allowed_domains:
        links = links.where(url_host(F.col("link")).isin(*allowed_domains))
    if allow_pattern:
        links = links.where(F.col("link").rlike(allow_pattern))
    return links.select("page_id", T.canonical_url(F.col("link")).alias("link_id")).distinct()


def out_links(pages: DataFrame, known_ids: DataFrame | None = None,
              allowed_domains: list[str] | None = None, allow_pattern: str | None = None) -> DataFrame:
    """One crawl-frontier step. Links of each page, resolved against the
    page, kept when host and URL are allowed; ``follow`` is true when the
    canonical link is not a known page id (anti join)."""
    links = page_links(pages, allowed_domains, allow_pattern)
    known = known_ids if known_ids is not None else with_canonical_id(pages).select("canonical_id")
    known = known.select(F.col(known.columns[0]).alias("link_id")).distinct()
    fresh = links.join(known, "link_id", "left_anti").select("page_id", "link_id", F.lit(True).alias("follow"))
    seen = links.join(known, "link_id", "left_semi").select("page_id", "link_id", F.lit(False).alias("follow"))
    return fresh.unionByName(seen)


TITLE_PATTERN = r"(?is)<title\b[^>]*>(.*?)(?:</title>|$)"
H1_PATTERN = r"(?is)<h1\b[^>]*>(.*?)(?:</h1>|$)"


def inner_text(html: Column) -> Column:
    """The trimmed texts between tags, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(html, "<[^>]*>"), T.py_strip), lambda t: t != ""), " ")


def title_and_h1(pages: DataFrame) -> DataFrame:
    """C4 natively: first title and all h1 texts, with those of tags inside."""
    h1 = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(H1_PATTERN), 1), inner_text), " ")
    return pages.select("page_id", inner_text(F.regexp_extract("html", TITLE_PATTERN, 1)).alias("title"), T.py_strip(h1).alias("h1"))


def page_items(pages: DataFrame, content_tag: str = "div", content_class: str | None = "wiki-content",
               h1_class: str | None = "with-breadcrumbs") -> DataFrame:
    """C4-C7 as one Spark job: every page parsed once inside ``mapInPandas``.

    Output: (page_id, url, title, hierarchy, heading, content); pages
    without a content element are dropped (C5).
    """
    def render(batches):
        for pdf in batches:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                item = H.page_item(html, content_tag, content_class, h1_class)
                if item is not None:
                    rows.append({"page_id": pid, "url": url, **item})
            yield pd.DataFrame(rows, columns=[f.name for f in ITEM_SCHEMA.fields])

    return pages.select("page_id", "url", "html").mapInPandas(render, ITEM_SCHEMA)


@F.pandas_udf(Ty.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """C7 as an Arrow-batched UDF (Spark has no NFKD function)."""
    return s.map(lambda v: None if v is None else H.ascii_fold(v))


def clean_items(items: DataFrame) -> DataFrame:
    """C1, C2, C8-C11 on crawled items -> docs(doc_id, title, heading, content).

    Order of the original pipeline: validity of the raw item (title present,
    content non-empty), de-duplication by canonical id (first page wins),
    sanitising, validity of the cleaned item.
    """
    valid_raw = items.where(F.col("title").isNotNull() & (F.col("content") != ""))
    deduped = first_per_key(with_canonical_id(valid_raw), "canonical_id", "page_id")
    title = T.sanitize(F.col("title"))
    heading = T.sanitize(F.col("heading"))
    lines = T.clean_lines(F.col("content"))
    docs = deduped.select(
        F.col("canonical_id").alias("doc_id"), "page_id", "url",
        title.alias("title"),
        F.concat(F.coalesce(F.col("hierarchy"), F.array().cast("array<string>")), F.array(heading)).alias("heading"),
        lines.alias("content"),
        heading.alias("_h"))
    keep = ((F.length("title") > 0) | (F.length("_h") > 0)) & (F.size("content") > 0)
    return docs.where(keep).drop("_h")


def docs_from_pages(pages: DataFrame, content_tag: str = "div", content_class: str | None = "wiki-content",
                    h1_class: str | None = "with-breadcrumbs") -> DataFrame:
    """Entry C: pages -> docs."""
    return clean_items(page_items(pages, content_tag, content_class, h1_class))


def kb_input_from_docs(docs: DataFrame, product_prefix: str = "/display/") -> DataFrame:
    """docs -> KB input (doc_id, doc_order, product, heading, content).

    Product = C12 on the doc URL; when it does not match, the URL host is
    used instead of aborting the run [decision].
    """
    host = url_host(F.col("doc_id"))
    product = F.coalesce(T.product_key(F.col("doc_id"), product_prefix),
                         F.when(host != "", host), F.lit(""))
    return docs.select("doc_id", F.col("page_id").alias("doc_order"), product.alias("product"),
                       "heading", "content")


def kb_input_from_documents(documents: DataFrame) -> DataFrame:
    """Driver ``documents`` table -> KB input.

    Each document is a page of product = source and breadcrumb = lang; its
    page heading is the first sentence of its first line, if that is as short
    as a title, else ``document <doc_id>``; lines are cleaned by C9 and all
    stay content.
    """
    title = F.try_element_at(T.sentences(F.try_element_at("content", F.lit(1))), F.lit(1))
    return documents.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("doc_id").cast("long").alias("doc_order"),
        F.col("source").alias("product"), "lang",
        T.clean_lines(F.col("text")).alias("content"),
    ).select("doc_id", "doc_order", "product", F.array(F.col("lang"), F.coalesce(
        F.when(F.length(title) <= TITLE_LENGTH, title), F.concat(F.lit("document "), F.col("doc_id")))).alias("heading"),
        "content")
