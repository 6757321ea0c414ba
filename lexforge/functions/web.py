"""URLs, file types and web pages."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "fbclid", "gclid", "mc_cid", "mc_eid", "source", "sxsrf")
# File types by extension, content types by extension (in order) and by parts of the Content-Type header.
FILE_TYPES = {".txt": "text", ".md": "text", ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".html": "html", ".htm": "html", ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".mp4": "audio"}
URL_TYPES = {".pdf": "pdf", ".html": "html", ".htm": "html", ".txt": "text", ".md": "markdown", ".xml": "xml", ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".mp4": "video", ".webm": "video"}
HEADER_TYPES = {"pdf": "pdf", "html": "html", "text/plain": "text", "audio": "audio", "video": "video", "xml": "xml"}
# General types.
GENERAL_TYPES = {"audio": "audio", "pdf": "text", "html": "html", "text": "text", "docx": "text", "doc": "text", "video": "video", "markdown": "text", "xml": "text", "unknown": "text"}
# Elements that never hold an article's text, class or id words of page furniture, elements that begin a line.
STRIP = frozenset("script style nav footer header aside iframe noscript form button svg figure figcaption img video audio source picture".split())
NOISE = re.compile("sidebar|widget|advert|promo|popup|modal|cookie|consent|newsletter|social|share|comment|related|recommend|footer|nav|menu|breadcrumb|signup|subscribe|banner|sponsor", re.IGNORECASE)
BREAKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li tr blockquote pre section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = re.compile(r"(article|post|entry|content|story)[-_]?(body|text|content)?", re.IGNORECASE)
# Metadata of the date, in order, and the least length of an article.
DATES = ("article:published_time", "datePublished", "og:article:published_time")
MIN_ARTICLE = 100


# Scheme, authority, path and query of a URL.
URL_PARTS = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?"


def normalize_url(url: Column | str) -> Column:
    """Scheme and host in lower case without www., no trailing slashes, fragment, path parameters, tracking or blank query
    values; the rest of the query sorted by name and encoded again. A host of unpaired brackets makes it no URL: that is
    only lower-cased."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "^\\s+|\\s+$", "")
    scheme, host, path, query = (F.regexp_extract(u, URL_PARTS, i) for i in range(1, 5))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def pair(p: Column, i: Column) -> Column:
        at = F.instr(p, "=")
        return F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.when(at > 0, decoded(F.substr(p, at + 1))).otherwise("").alias("v"))

    pairs = F.filter(F.transform(F.split(query, "&"), pair), lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING))
    kept = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    bare = F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+$", "")
    found = F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), F.regexp_replace(F.lower(host), "^www\\.", ""))).otherwise(""),
        bare,
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )
    broken = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    return F.when(broken, F.regexp_replace(F.lower(u), "/+$", "")).otherwise(found)


def file_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv]), extension), F.lit("unknown"))


def general_type(kind: Column) -> Column:
    """Files and contents by what is done with them; text for what is not known."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GENERAL_TYPES.items() for x in kv]), kind), F.lit("text"))


def is_arxiv(url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("arxiv.org")), F.lit(False))


def arxiv_pdf(url: Column) -> Column:
    return F.replace(F.coalesce(url, F.lit("")), F.lit("/abs/"), F.lit("/pdf/"))


def best_pdf_url(work: Column) -> Column:
    """Of a struct of a scholarly work: its cached content, else the open, the primary or the first other location's PDF, else
    an open link that ends like one, else empty."""
    given = lambda x: F.when(x != "", x)
    elsewhere = F.try_element_at(F.filter(work["locations"], lambda x: F.coalesce(x["pdf_url"], F.lit("")) != ""), F.lit(1))["pdf_url"]
    link = work["open_access"]["oa_url"]
    return F.coalesce(
        F.when(F.coalesce(work["has_content"]["pdf"], F.lit(False)), given(work["content_url"])),
        given(work["best_oa_location"]["pdf_url"]),
        given(work["primary_location"]["pdf_url"]),
        elsewhere,
        F.when(F.lower(link).endswith(".pdf"), link),
        F.lit(""),
    )


def best_url(work: Column) -> Column:
    """The DOI, else the primary location's page, else the id."""
    given = lambda x: F.when(x != "", x)
    return F.coalesce(given(work["doi"]), given(work["primary_location"]["landing_page_url"]), work["id"], F.lit(""))


def content_type(url: Column, header: Column) -> Column:
    """By the extension of the URL's path, else by the header."""
    path = F.lower(F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("PATH"))), F.lit("")))
    head = F.lower(F.coalesce(header, F.lit("")))
    out = F.lit("unknown")
    for part, kind in reversed(HEADER_TYPES.items()):
        out = F.when(head.contains(part), kind).otherwise(out)
    for extension, kind in reversed(URL_TYPES.items()):
        out = F.when(path.endswith(extension), kind).otherwise(out)
    return out


def domain(url: Column) -> Column:
    """With the port, if any."""
    return F.parse_url(url, F.lit("AUTHORITY"))


def strip_tags(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), "\\s+", " "))


def collapse(text: Column) -> Column:
    """Blank lines to one, runs of blanks to one, no blanks around line ends."""
    lines = F.regexp_replace(text, "\\n\\s*\\n", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, "[ \\t]+", " "), " *\\n *", "\n"))


class _Page(HTMLParser):
    """Texts outside of furniture, each with the kinds of container that it stands in, and the head's metadata."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []
        self.parts: list[tuple[frozenset, str]] = []
        self.title: list[str] = []
        self.heading: list[str] = []
        self.meta: dict[str, str] = {}
        self.dated = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        named = f"{a.get('class', '')} {a.get('id', '')}"
        kind = "article" if tag in ("article", "main") or a.get("role") == "main" else "content" if tag == "div" and CONTENT.search(named) else ""
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or "", a.get("content", ""))
        if a.get("itemprop") == "datePublished":
            self.dated = self.dated or a.get("datetime") or a.get("content", "")
        if tag in BREAKS:
            self._add("\n")
        if tag not in VOID:
            self.open.append((tag, tag in STRIP or bool(NOISE.search(named)), kind))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        elif data.strip():
            if any(tag == "h1" for tag, _, _ in self.open):
                self.heading.append(data.strip())
            self._add(data.strip())

    def _add(self, part: str) -> None:
        if not any(noisy or tag == "head" for tag, noisy, _ in self.open):
            self.parts.append((frozenset(kind for _, _, kind in self.open), part))


def _parsed(markup: str | None) -> _Page:
    p = _Page()
    p.feed(markup or "")
    p.close()
    return p


def article(markup: str | None) -> tuple[str, str]:
    """(title, text) of a page: what stands in its article or main element, if long enough, else in a div that is named like
    content, else in its body; empty if that is too short, too."""
    p = _parsed(markup)
    title = html.unescape("".join(p.title)).strip()
    for kind in ("article", "content", None):
        text = " ".join(x for kinds, x in p.parts if kind is None or kind in kinds).strip()
        if len(text) >= MIN_ARTICLE:
            return title, re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n", "\n\n", text))).strip()
    return title, ""


def metadata(markup: str | None, modified: str = "") -> tuple[str, str, str, str]:
    """(title, author, published, description) of a page: the title as shared, else its own, else its first heading; the date of
    its metadata, else of its microdata, else of the server. Scripts are no source, as they are dropped before."""
    p = _parsed(markup)
    title = p.meta.get("og:title", "".join(p.title) if p.title else "".join(p.heading[:1]))
    date = next((p.meta[n] for n in DATES if n in p.meta), p.dated or modified)
    return html.unescape(title).strip(), p.meta.get("author", ""), date, p.meta.get("og:description", p.meta.get("description", ""))


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "author", "published", "description")]))
def page_metadata(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(x) for x in pages], columns=["title", "author", "published", "description"])


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def extract_article(pages: pd.Series) -> pd.DataFrame:
    """A struct of title and text; pages are parsed in Arrow batches."""
    return pd.DataFrame([article(x) for x in pages], columns=["title", "text"])
