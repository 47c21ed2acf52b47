"""URL filter that follows redirects and canonical links.

Rules name a host with its subdomains and the start of a path; the longest
fitting rule decides. Addresses that redirect to each other or name each other
as canonical are aliases: a distributed connected-components run over those
edges carries decisions to the addresses that no rule fits. Among aliases an
explicit allow goes before a block, and an address's own rule before both. An
address without any decision is allowed.

Only DataFrame expressions are used. A null address or one without ``://`` has
an empty host and path, fits no rule and has no aliases; a null html has no
edges. Rows with a repeated page_id or address are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators.stars import linked_components as components

#: (host with its subdomains, start of the path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Markup in which a link doesn't count.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
#: The first base that has an address.
_BASE = r"(?is)<base\b[^>]*\bhref\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))"
_TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'>]+)"


def host_of(url: str) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules=RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` and ``_own``, the verdict of the longest fitting rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return df.withColumns({"rule": rule, "_own": verdict})


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4: a path without the segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1)))))
        .otherwise(F.concat(done, F.array(part))),
    )
    whole = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.contains("/."), whole).otherwise(path)


def address(url: Column) -> Column:
    """What two spellings of one address share: host and the rest without
    scheme, dot segments and fragment. Null where there is no host."""
    text = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = _without_dots(F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?]*)", 1))
    query = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*[^?]*(.*)$", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _decoded(link: Column) -> Column:
    """``link`` with its numeric references and ``&amp;`` as characters."""

    def character(found):
        code = F.when(found.rlike("(?i)x"), F.conv(F.regexp_extract(found, r"([0-9a-fA-F]+);", 1), 16, 10)).otherwise(
            F.regexp_extract(found, r"([0-9]+);", 1)
        ).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        said = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code == 38, "&amp;").when(known, said).otherwise(found)

    found = F.array_distinct(F.regexp_extract_all(link, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), 0))
    plain = F.aggregate(found, link, lambda done, one: F.replace(done, one, character(one)))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def _absolute(link: Column, url: Column) -> Column:
    """RFC 3986, 5.2.2; dot segments go in ``address``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``u, v``: addresses that a page ties together by a canonical link or an
    immediate redirect in its html."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, "")
    tags = F.regexp_extract_all(shown, F.lit(_TAGS), 0)
    named = F.regexp_extract(shown, _BASE, 0)
    base = _decoded(F.trim(F.concat(*[F.regexp_extract(named, _HREF, k) for k in (1, 2, 3)])))
    marked = F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    found = (
        pages.where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").isNotNull())
        .select("url", base.alias("_base"), F.explode(marked).alias("_tag"))
        .select(
            "url",
            F.coalesce(_absolute(F.col("_base"), F.col("url")), "url").alias("_from"),
            F.trim(
                F.when(
                    F.col("_tag").rlike(_CANONICAL),
                    F.concat(*[F.regexp_extract("_tag", _HREF, k) for k in (1, 2, 3)]),
                ).otherwise(F.regexp_extract("_tag", _TARGET, 1))
            ).alias("_link"),
        )
    )
    target = address(_absolute(_decoded(F.col("_link")), F.col("_from")))
    return found.select(address(F.col("url")).alias("u"), target.alias("v")).where("u <> v")


def judged(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page. ``edges`` (u, v)
    are the aliases; by default those that the pages themselves name."""
    edges = alias_edges(pages) if edges is None else edges
    ruled = with_rule(pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path")), rules)
    members = components(edges)
    # Every address of a component may carry a decision, fetched page or not.
    whole = F.concat(F.lit("x://"), F.col("u"))
    spoken = (
        with_rule(members.withColumns({"host": host_of(whole), "path": path_of(whole)}), rules)
        .groupBy("component")
        .agg(F.bool_or(F.col("_own") == "allow").alias("_allow"), F.bool_or(F.col("_own") == "block").alias("_block"))
    )
    aliases = members.join(spoken, "component").select(
        "u", F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").alias("_alias")
    )
    return (
        ruled.withColumn("u", address(F.col("url")))
        .join(aliases, "u", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))
    )
