"""Landing pages and downloads: what a page says, which link is the paper, how an attempt ended."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import rules as R
from lodestone.functions.markup import Attr, Selector, select
from lodestone.functions.text import clean_text
from lodestone.operators.shared import small_batches

MIN_BYTES = 15_000
#: What asks for a name and a password.
LOGINS = (
    Selector("input", (Attr("type", "=", "password", True),)),
    Selector("form", (Attr("action", "*", "login", True),)),
    Selector("form", (Attr("action", "*", "signin", True),)),
    Selector(None, (Attr("id", "*", "loginForm", True),)),
    Selector(None, (Attr("class", "*", "login-form", True),)),
)


def page_text(page: Column) -> Column:
    """Lower-case text of a page's body; scripts and styles are no text."""
    return F.lower(clean_text(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def challenge(text: Column, packs=R.CHALLENGES) -> Column:
    """The first kind of bot protection whose words occur, or null."""
    return F.coalesce(*[F.when(_any(text, words), F.lit(name)) for name, words in packs])


def login(page: Column) -> Column:
    return read_page(page, F.lit(""), logins=LOGINS)["login"]


def paywall(text: Column, words: tuple[str, ...] = R.PAYWALL) -> Column:
    return _any(text, words)


def supplementary(url: Column) -> Column:
    return _any(F.lower(url), R.SUPPLEMENTARY)


def _joined(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link.strip()) if link.strip() else None
    except ValueError:  # such as a broken IPv6 address
        return None


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links against their pages' urls; null where one is null or blank, or the link is no url."""
    return pd.Series([_joined(b, x) if b is not None and x is not None else None for b, x in zip(base, link, strict=True)], dtype="object")


def _link(*attrs: Attr, within: str = "", says: str | None = None, matches: str | None = None) -> Selector:
    return Selector("a", attrs, (Attr("class", "*", within),) if within else (), says, matches)


#: Links to a paper's file in order of preference.
PDF_LINKS = (
    _link(Attr("data-track-action", "=", "download pdf", True)),
    _link(Attr("data-track-action", "=", "pdf download", True)),
    _link(Attr("data-article-url", "$", ".pdf")),
    _link(Attr("href", "$", ".pdf")),
    _link(Attr("href", "*", "/pdf/"), Attr("href", "*", "doi")),
    _link(Attr("href", "*", "/pdf/")),
    _link(Attr("title", "=", "Download PDF", True)),
    _link(Attr("title", "=", "PDF", True)),
    _link(Attr("aria-label", "*", "Download PDF", True)),
    _link(Attr("aria-label", "*", "PDF", True)),
    _link(within="c-pdf-download"),
    _link(within="pdf-download"),
    _link(within="download-pdf"),
    _link(says="PDF"),
    _link(matches="(?i)^Download PDF$"),
    _link(matches="(?i)Full.?Text PDF"),
    _link(matches="(?i)View PDF"),
    _link(matches="(?i)Open PDF"),
)


def read_page(page: Column, url: Column, links: tuple[Selector, ...] = (), logins: tuple[Selector, ...] = ()) -> Column:
    """struct(login boolean, links array<string>): whether an element meets one of `logins`; hrefs of what meets `links`, selector by selector, resolved against url, each once."""

    @F.pandas_udf("login boolean, links array<string>")
    def read(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        out = []
        for p, u in zip(pages, urls, strict=True):
            found = select(p, (*links, *logins))
            hrefs = [_joined(u or "", attrs.get("href", "")) for f in found[: len(links)] for attrs in f]
            out.append((any(found[len(links) :]), list(dict.fromkeys(h for h in hrefs if h))))
        return pd.DataFrame(out, columns=["login", "links"])

    return read(page, url)


def _chosen(url: Column, links: Column) -> Column:
    own = F.when(F.lower(url).endswith(".pdf") & ~supplementary(url), url)
    doi = F.split_part(F.nullif(F.regexp_extract(url, r"(10\.\d{4,}/\S+)", 1), F.lit("")), F.lit("?"), F.lit(1))
    acs = F.when(url.contains("pubs.acs.org") & doi.isNotNull(), F.concat(F.lit("https://pubs.acs.org/doi/pdf/"), doi))
    return F.coalesce(own, acs, F.get(F.filter(links, lambda x: ~supplementary(x)), 0), F.get(links, 0))


def pdf_link(page: Column, url: Column, links: tuple[Selector, ...] = PDF_LINKS) -> Column:
    """The page itself if it is a file; a publisher's rule; else the first link that is no supplement, else the first link, resolved against the page's url."""
    return _chosen(url, read_page(page, url, links)["links"])


def page_class(pages: DataFrame, page: str = "html", url: str = "url", challenges=R.CHALLENGES, walls=R.PAYWALL, links: tuple[Selector, ...] = PDF_LINKS, logins: tuple[Selector, ...] = LOGINS) -> DataFrame:
    """pages without their markup, with challenge, login, paywall, pdf_link; tags are read once a page."""
    small_batches(pages.sparkSession)
    t = F.col("_t")
    d = pages.withColumns({"_t": page_text(F.col(page)), "_read": read_page(F.col(page), F.col(url), links, logins)})
    return d.select(*[c for c in pages.columns if c != page], challenge(t, challenges).alias("challenge"), F.col("_read.login").alias("login"), paywall(t, walls).alias("paywall"), _chosen(F.col(url), F.col("_read.links")).alias("pdf_link"))


def valid_file(content: Column, content_type: Column, min_bytes: int = MIN_BYTES) -> Column:
    """Starts as a PDF or is called one, and is large enough."""
    return ((F.substring(content, 1, 4) == F.lit(b"%PDF")) | F.lower(content_type).contains("application/pdf")) & (F.octet_length(content) >= min_bytes)


def oa_urls(best: Column, locations: Column) -> Column:
    """Distinct non-blank urls, the best first."""
    return F.array_distinct(F.filter(F.concat(F.array(best), F.coalesce(locations, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))


def attempt_status(papers: DataFrame, attempts: DataFrame, key: str = "row") -> DataFrame:
    """papers (key, exists boolean) with status and the url that worked.

    attempts: key, ordinal, url, ok. REUSED if the file exists, NO_OA_URL without attempts, SUCCESS with the first that worked, else DOWNLOAD_FAILED.
    """
    a = attempts.groupBy(key).agg(F.count("*").alias("n"), F.min(F.when(F.col("ok"), F.struct("ordinal", "url"))).alias("won"))
    status = F.when(F.col("exists"), "REUSED").when(F.coalesce("n", F.lit(0)) == 0, "NO_OA_URL").when(F.col("won").isNotNull(), "SUCCESS").otherwise("DOWNLOAD_FAILED")
    return papers.join(a, key, "left").select(*[papers[c] for c in papers.columns], status.alias("status"), F.when(status == "SUCCESS", F.col("won.url")).otherwise("").alias("url"))


def union_urls(services: dict[str, Column]) -> Column:
    """array of struct(source, url): the urls of several services one after the other, in the order of the dict; blanks and nulls out, repeats stay with their source."""
    parts = [F.transform(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != "")), _sourced(name)) for name, urls in services.items()]
    return F.concat(*parts)


def _sourced(name: str):
    return lambda u: F.struct(F.lit(name).alias("source"), u.alias("url"))


def attempts_of(papers: DataFrame, services: dict[str, Column], key: str = "row") -> DataFrame:
    """key, ordinal (from 1), source, url: what is to be tried, in order."""
    return papers.select(key, F.posexplode(union_urls(services)).alias("n", "x")).select(key, (F.col("n") + 1).alias("ordinal"), "x.source", "x.url")


def nav_url(url: Column, doi: Column) -> Column:
    """Where a visit starts: the url if it is one, else the DOI's, else null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u.startswith("http"), u).when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi))


def visit_status(visits: DataFrame) -> DataFrame:
    """visits with status and status_notes: how a visit to a paper's page ended, by the first step that failed.

    visits: nav_url (string or null), timed_out (boolean), challenge (its name or null), challenge_left, login_left
    (booleans: still there after a second look), paywall (boolean), page_url, pdf_link (string or null), file_bytes (long or null),
    file_head (binary or null: the first bytes of what was saved), min_bytes (long). Null booleans are false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = [
        (F.col("nav_url").isNull(), "SKIP", F.lit("No DOI or URL")),
        (yes("timed_out"), "TIMEOUT", F.lit("Page load timeout")),
        (F.col("challenge").isNotNull() & yes("challenge_left"), "CHALLENGE_UNRESOLVED", F.concat("challenge", F.lit(" challenge not cleared"))),
        (yes("login_left"), "LOGIN_REQUIRED", F.lit("Login wall still present after manual attempt")),
        (yes("paywall"), "ACCESS_DENIED", F.lit("Paywall — no institutional access")),
        (F.coalesce("pdf_link", F.lit("")) == "", "NO_PDF_LINK", F.concat(F.lit("No PDF link at "), F.coalesce("page_url", F.lit("")))),
        (F.coalesce("file_bytes", F.lit(-1)) < F.col("min_bytes"), "DOWNLOAD_FAILED", F.lit("No valid file produced")),
        (F.coalesce(F.substring("file_head", 1, 5) != F.lit(b"%PDF-"), F.lit(True)), "INVALID_FILE", F.lit("Not a valid PDF")),
    ]
    status = notes = None
    for cond, name, note in steps:
        status = F.when(cond, name) if status is None else status.when(cond, name)
        notes = F.when(cond, note) if notes is None else notes.when(cond, note)
    return visits.withColumns({"status": status.otherwise("SUCCESS"), "status_notes": notes.otherwise(F.concat(F.lit("Downloaded from "), "pdf_link"))})


def pick_row(records: DataFrame, row: int | None, key: str = "row") -> DataFrame:
    """All records, or the one numbered `row`; a number that is not there raises IndexError. Numbers run from 1 without gaps."""
    if row is None:
        return records
    n = records.agg(F.max(key)).first()[0] or 0
    if not 1 <= row <= n:
        raise IndexError(f"Row must be between 1 and {n}; got {row}.")
    return records.where(F.col(key) == row)
