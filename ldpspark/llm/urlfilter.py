"""URL filters with redirect equivalence.

Rules judge an address by host suffix and path prefix. Addresses that redirect to each other, or name the same canonical
address, are one thing: a page without a rule of its own takes over the block of any alias, unless an alias is
explicitly allowed. Aliases are the connected components of redirect and canonical-link edges over normal forms.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ldpspark.session import settle

from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# query parameters that do not change the page
TRACKING = r"(?i)(^|&)(?:utm_[^=&#]*|ref|fbclid|gclid)=[^&#]*"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: str | Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_of(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """``(rule, verdict)`` of the longest rule that fits, allow before block at the same length; else NULLs. The rules
    are a short list given by the caller and become one expression."""
    found = [F.lit(None).cast("struct<rule:string,verdict:string>")]
    for rule in sorted(rules, key=lambda r: (len(r.text), r.action == "allow", r.text)):
        own = F.col(host) == F.lit(rule.host)
        fits = (own | F.endswith(F.col(host), F.lit("." + rule.host))) & F.startswith(F.col(path), F.lit(rule.path))
        named = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.action).alias("verdict"))
        found.append(F.when(fits, named).otherwise(found[-1]))
    return found[-1]


def normal_form(url: Column) -> Column:
    """An address without scheme, ``www.``, default port, fragment, tracking parameters and final slash; NULL without
    a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.(.+\..+)$", "$1")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&+|&+$", "")
    whole = F.concat(host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))
    return F.when(host != "", whole)


def resolve(base: Column, link: Column) -> Column:
    """A link of the page ``base`` as an absolute address."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of normal forms from canonical links and refreshes in ``html``."""
    canonical = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
        lambda tag: F.regexp_like(tag, F.lit(r"(?is)\srel\s*=\s*[\"']?canonical\b")),
    )
    refresh = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
        lambda tag: F.regexp_like(tag, F.lit(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b")),
    )
    hrefs = F.transform(canonical, lambda tag: F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    targets = F.transform(refresh, lambda tag: F.regexp_extract(tag, r"(?is);\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    marked = pages.where(F.regexp_like("html", F.lit(r"(?i)canonical|refresh"))).select("url", "html")
    links = marked.select("url", F.explode(F.concat(hrefs, targets)).alias("link")).where("link != ''")
    return links.select(normal_form(F.col("url")).alias("u"), normal_form(resolve(F.col("url"), F.col("link"))).alias("v"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, alias_of``.

    ``pages`` has ``page_id, url, html``; ``redirects`` may add edges ``(from_url, to_url)``. A page with a rule has the
    rule's verdict. Any other page is blocked if an alias has a block rule and none has an allow rule, and else
    allowed. NULL or malformed addresses have empty host and path, no alias, and are allowed. Repeated rows are judged
    each. Other columns are not read.
    """
    edges = page_links(pages)
    if redirects is not None:
        more = redirects.select(normal_form(F.col("from_url")).alias("u"), normal_form(F.col("to_url")).alias("v"))
        edges = edges.unionByName(more)
    roots = settle(components(edges).withColumnRenamed("root", "alias_of"))
    seen = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), normal_form(F.col("url")).alias("form"))
    ruled = seen.withColumn("own", rule_of(rules)).join(roots, F.col("form") == F.col("node"), "left")
    ruled = ruled.select("page_id", "host", "path", "own", F.coalesce("alias_of", "form").alias("alias_of"))
    # ends of redirects need not be pages themselves; their rules count too. Normal forms have lost their final slash
    ends = roots.select(
        "alias_of",
        F.regexp_extract("node", r"^[^/?]*", 0).alias("host"),
        F.concat(F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), F.lit("/")).alias("path"),
    )
    votes = ruled.where("own is not null").select("alias_of", "own.verdict").unionByName(
        ends.withColumn("own", rule_of(rules)).where("own is not null").select("alias_of", "own.verdict")
    )
    tally = votes.groupBy("alias_of").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    blocked = settle(tally.where("not allowed").select(F.col("alias_of").alias("blocked")))
    judged = ruled.join(blocked, F.col("alias_of") == F.col("blocked"), "left")
    spread = F.when(F.col("blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", spread).alias("verdict"), "alias_of")
