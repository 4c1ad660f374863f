"""URL rules, and the spread of block decisions over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import kept_columns, let, with_row
from claimscope.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return f"{self.host}{self.path}"


# The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

# The address in the attributes of <link rel="canonical"> and <meta http-equiv="refresh">.
_TAGS = r"(?i)<(?:link|meta)\s[^>]*>"
_CANONICAL = r"(?i)\srel\s*=\s*[\"']?canonical[\"'\s/>]"
_HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
_TARGET = r"(?i)\scontent\s*=\s*[\"'][^\"']*?url\s*=\s*([^\"'\s>]+)"


_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; else empty."""
    return _ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Label and verdict of the longest rule that fits, as a struct, else NULL.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of
    rules of one length, allow wins, then the label's order decides.
    """
    best = F.lit(None).cast("struct<label:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.label), r.verdict == "allow", r.label)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.label).alias("label"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def _without_dots(path: Column) -> Column:
    """A path from the root, with the segments ``.`` and ``..`` carried out."""
    kept = F.aggregate(
        F.slice(F.split(path, "/", -1), 2, F.length(path) + 1),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
        lambda done: F.concat(F.lit("/"), F.array_join(done, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(done) > 0), "/").otherwise("")),
    )
    return kept


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute address, resolved against the address ``base`` of its page.

    Only a link that begins with a scheme and ``://`` stands by itself. Others start from the
    page's scheme, host, path or folder. Links of another kind (``mailto:``), and those of a
    page without a host, give NULL.
    """

    def joined(at: Column) -> Column:
        origin, path = F.concat(at["scheme"], F.lit("://"), at["host"]), F.when(at["path"] == "", "/").otherwise(at["path"])
        return (
            F.when(link.rlike(_ABSOLUTE), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (at["host"] == ""), None)
            .when(link.startswith("//"), F.concat(at["scheme"], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.startswith("?"), F.concat(origin, path, link))
            .when(link.startswith("#"), base)
            .otherwise(F.concat(origin, F.regexp_extract(path, r"^[\s\S]*/", 0), link))
        )

    def resolved(full: Column) -> Column:
        part = lambda k: F.regexp_extract(full, r"^([^:]*://[^/?#]*)([^?#]*)([\s\S]*)$", k)
        return F.when(part(2).rlike(r"/\.\.?(/|$)"), F.concat(part(1), let(part(2), _without_dots), part(3))).otherwise(full)

    place = F.struct(F.regexp_extract(base, r"^([^:/?#]+):", 1).alias("scheme"), host_of(base).alias("host"), path_of(base).alias("path"))
    return let(let(place, joined), resolved)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", by_query: bool = False) -> DataFrame:
    """(a, b): a page's node and the node its redirect or canonical link points to.

    A node is host and path, with ``by_query`` the query too; scheme and fragment do not part
    aliases.
    """
    page, body = F.col(f"`{url}`"), F.col(f"`{html}`")
    tags = F.regexp_extract_all(body, F.lit(_TAGS), F.lit(0))
    link = F.transform(
        tags,
        lambda tag: F.when(tag.rlike(_CANONICAL), F.regexp_extract(tag, _HREF, 1)).when(
            tag.rlike(_REFRESH), F.regexp_extract(tag, _TARGET, 1)
        ),
    )
    links = pages.select(page.alias("page"), F.explode(F.filter(link, lambda x: x.isNotNull() & (x != ""))).alias("link"))
    # In html an ampersand of an address is mostly written as an entity.
    target = absolute(F.regexp_replace("link", "(?i)&(amp|#38|#x26);", "&"), F.col("page"))
    ends = links.select(node_of(F.col("page"), by_query).alias("a"), node_of(target, by_query).alias("b"))
    return ends.where("a is not null and b is not null and a <> b").distinct()


def node_of(url: Column, by_query: bool = False) -> Column:
    """Host and path as one text, ``/`` where the path is empty; NULL where there is no host.

    With ``by_query`` a query that is not empty follows, so that it parts pages.
    """

    def node(rest: Column) -> Column:
        part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)(\?[^#]+)?", k)
        whole = F.concat(_ascii_lower(part(1)), F.when(part(2) == "", "/").otherwise(part(2)), *([part(3)] if by_query else []))
        return F.when(part(1) != "", whole)

    return let(_after_scheme(url), node)


def judge(
    pages: DataFrame,
    rules: Sequence[UrlRule] = RULES,
    edges: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
    keep: Sequence[str] = ("page_id",),
    by_query: bool = False,
) -> DataFrame:
    """Per page: the columns ``keep``, host, path, rule and verdict (allow or block).

    A page with a rule gets the rule's verdict, so an explicit allow stands whatever its
    aliases are. Any other page is blocked if an alias of it is blocked by a rule, be the
    alias a page or only the target of a link, and else allowed. Aliases are the connected
    components over redirects and canonical links (``edges``: further pairs of addresses in
    columns a and b, such as a crawler's redirect log). Without ``by_query``, addresses of one
    host and path count as one page; with it, only those that share the query as well.

    A NULL address or one without ``://`` has empty host and path, no rule and no alias, and
    is allowed. A NULL html has no links. Repeated rows get equal verdicts. A kept column
    that bears the name of a result column is called ``row_<name>``.
    """
    links = alias_edges(pages, url, html, by_query)
    if edges is not None:
        more = edges.select(node_of(F.col("a"), by_query).alias("a"), node_of(F.col("b"), by_query).alias("b"))
        links = links.union(more.where("a is not null and b is not null and a <> b"))
    members = connected_components(links, "a", "b")
    # A member is judged by its own address: up to the first slash a node is the host.
    host = F.regexp_extract("node", r"^[^/]*", 0)
    path = F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    verdicts = members.select("node", "component", best_rule(host, path, rules)["verdict"].alias("v"))
    blocked = verdicts.where("v = 'block'").select("component").distinct()
    tainted = members.join(blocked, "component", "left_semi").select(F.col("node").alias("tainted")).distinct()

    address = F.col(f"`{url}`")
    judged = with_row(
        pages.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*keep, url)))),
        host=host_of(address),
        path=path_of(address),
        node=node_of(address, by_query),
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    joined = judged.join(tainted, judged["node"] == tainted["tainted"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("tainted").isNotNull(), "block").otherwise("allow"))
    return joined.select(*kept_columns(keep, ("host", "path", "rule", "verdict")), "host", "path", F.col("best.label").alias("rule"), verdict.alias("verdict"))
