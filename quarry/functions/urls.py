"""URL expressions: normal form, scope, paths, repository addresses, links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

MAX_URL = 255


def host(url: Column) -> Column:
    """Lower-case host with a port that is not the scheme's own."""
    authority = F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)\Ahttps?://([^/?#]+)", 1), r"\A[^@]*@", ""))
    plain = F.when(url.rlike(r"(?i)\Ahttp://"), F.regexp_replace(authority, r":80\z", "")).otherwise(F.regexp_replace(authority, r":443\z", ""))
    return F.when(plain != "", plain)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)\Ahttps?://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def normalize(url: Column) -> Column:
    """http(s) only; host in lower case, single slashes, no .md, no fragment, no last slash; query kept."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)\A(https?)://", 1))
    clean = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), r"(?i)\.md\z", "")
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]+)", 1)
    whole = F.concat(scheme, F.lit("://"), host(url), clean, query)
    return F.when(scheme != "", F.regexp_replace(whole, r"/\z", ""))


def in_scope(url: Column, root: str, allowed: list[str] | None = None, denied: list[str] | None = None, subdomains: bool = False) -> Column:
    """Same host (or a subdomain, if wished) and a path under an allowed prefix and no denied one."""
    root_host = F.lower(F.regexp_extract(F.lit(root), r"(?i)\Ahttps?://([^/?#]+)", 1))
    here = host(url) == root_host
    if subdomains:
        here = here | F.endswith(host(url), F.concat(F.lit("."), root_host))
    at = F.lower(path(url))
    for prefixes, wanted in ((allowed, True), (denied, False)):
        if prefixes:
            any_of = F.lit(False)
            for p in prefixes:
                any_of = any_of | at.startswith(p.lower())
            here = here & (any_of if wanted else ~any_of)
    return F.coalesce(here, F.lit(False))


def relative_path(url: Column) -> Column:
    """File name of a page: its path without outer slashes and page suffixes, plus .md; 'index' for the root."""
    bare = F.regexp_replace(F.regexp_replace(path(url), r"\A/", ""), r"/\z", "")
    bare = F.when(bare == "", F.lit("index")).otherwise(bare)
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\.html?\z", ""), r"(?i)\.md\z", "")
    return F.when(F.endswith(bare, F.lit(".md")), bare).otherwise(F.concat(bare, F.lit(".md")))


def is_llms_manifest(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"/llms[^/]*\.txt\z")


def repo_parts(url: Column) -> Column:
    """(owner, repo, ref, docs_path) of a repository address; null if it is none."""
    pattern = r"(?i)\A(?:https?://)?(?:www\.)?github\.com/([^/\s?#]+)/([^/\s?#]+?)(?:\.git)?(?:/(?:tree|blob)/([^/\s?#]+)(?:/([^?#]*?))?)?/?(?:[?#].*)?\z"
    part = lambda k: F.nullif(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.when(url.rlike(pattern), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("ref"), docs_path(part(4)).alias("docs_path")))


def docs_path(value: Column) -> Column:
    """Path without outer slashes; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.btrim(value), r"\A/+", ""), r"/+\z", ""), F.lit(""))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs[:] if k == "href" and v][:1]


def absolute(base: str | None, links: list[str]) -> list[str]:
    """Absolute forms of the targets of a page's links, each once, in order; those that run scripts are left out."""
    out = []
    for link in (h for h in links if h and not h.startswith("javascript:")):
        try:
            out.append(urljoin(base or "", link.strip()))
        except ValueError:
            continue
    return list(dict.fromkeys(out))


@pandas_udf(ArrayType(StringType()))
def html_links(page: pd.Series, url: pd.Series) -> pd.Series:
    """Absolute targets of all a[href] in page order; Python because references resolve against the page."""
    out = []
    for text, base in zip(page, url, strict=True):
        parser = _Anchors()
        parser.feed(text or "")
        out.append(absolute(base, parser.found))
    return pd.Series(out)


@pandas_udf(ArrayType(StringType()))
def resolved(links: pd.Series, url: pd.Series) -> pd.Series:
    """Absolute forms of link targets of a page, as ``absolute`` has them."""
    return pd.Series([absolute(base, list(found)) for found, base in zip(links, url, strict=True)])


MARKDOWN_LINK = re.compile(r"\[(?:[^\]]*)\]\(([^)\s]+)\)")


@pandas_udf(ArrayType(StringType()))
def markdown_links(text: pd.Series, url: pd.Series) -> pd.Series:
    """Absolute targets of markdown links in order, without fragments-only, mailto and tel."""
    return pd.Series([absolute(b, [h for h in MARKDOWN_LINK.findall(t or "") if not h.startswith(("#", "mailto:", "tel:"))]) for t, b in zip(text, url, strict=True)])


def scoped_links(links: Column, root: str, **scope) -> Column:
    """Normal forms of links, short enough and in scope, each once, in order."""
    normal = F.transform(links, normalize)
    return F.array_distinct(F.filter(normal, lambda x: x.isNotNull() & (F.length(x) <= MAX_URL) & in_scope(x, root, **scope)))
