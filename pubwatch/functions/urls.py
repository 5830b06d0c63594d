"""URL functions on Columns (regular expressions, because try_parse_url rejects URLs with blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import let, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_AUTHORITY = r"^(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def url_hostname(url: Column) -> Column:
    """Lower-case host without user info or port."""
    return F.lower(F.regexp_extract(url_netloc(url), _AUTHORITY, 1))


def url_port(url: Column) -> Column:
    return F.regexp_extract(url_netloc(url), _AUTHORITY, 2)


def url_host(url: Column) -> Column:
    """Lower-case host with a leading ``www.`` removed."""
    return F.regexp_replace(url_hostname(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, port kept, trailing slashes, query and fragment dropped."""
    def build(x: Column) -> Column:
        port = F.regexp_replace(url_port(x), "^0+", "")
        host = F.concat(url_hostname(x), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))
        path = F.regexp_replace(url_path(x), "/+$", "")
        absolute = F.concat(url_scheme(x), F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path))
        return F.when((url_scheme(x) == "") | (url_netloc(x) == ""), x).otherwise(absolute)

    return let(strip(url), build)


def _collapse_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)
        ).when(seg == ".", acc).otherwise(F.array_append(acc, seg)),
    )
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)


def url_join(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the page ``base``, dot segments included."""
    root = F.concat(url_scheme(base), F.lit("://"), url_netloc(base))
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    target = F.regexp_extract(href, r"^[^?#]*", 0)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def resolve(path: Column) -> Column:
        return F.when(F.contains(path, F.lit("/.")), _collapse_dots(path)).otherwise(path)

    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(_SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, resolve(target), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(strip_query(base), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, resolve(F.concat(folder, target)), tail))
    )


def same_site(left: Column, right: Column) -> Column:
    a, b = url_host(left), url_host(right)
    return hosts_related(a, b)


def hosts_related(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other; empty hosts never match."""
    return (a != "") & (b != "") & (
        (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
    )


def is_agency_homepage(link: Column, homepage: Column | None = None) -> Column:
    """A landing page: an organisation page of the government site, or the source's own homepage."""
    host = url_host(link)
    path = F.regexp_replace(url_path(link), "/+$", "")
    landing = (host == "gov.uk") & F.regexp_replace(path, "^/+", "").rlike("^government/organisations/[^/]*$")
    if homepage is None:
        return landing
    own = F.regexp_replace(url_path(homepage), "/+$", "")
    return landing | (F.coalesce(homepage, F.lit("")) != "") & (host != "") & (host == url_host(homepage)) & (path == own)


def route_category(url: Column) -> Column:
    path = url_path(url)
    return (
        F.when(url_hostname(url) == V.AGGREGATOR_HOST, F.lit("fallback"))
        .when(F.endswith(path, F.lit("/api/search.json")) | F.contains(path, F.lit("researchbriefings.json")), F.lit("search_api"))
        .otherwise(F.lit("list"))
    )


def content_type(link: Column, title: Column, context: Column | None = None) -> Column:
    """Record kind, first rule that fits: judgment, guidance, report, publication, news."""
    path = F.lower(url_path(link))
    words = F.lower(F.concat_ws(" ", link, title, *([context] if context is not None else [])))

    def hit(paths: tuple[str, ...], terms: tuple[str, ...] = ()) -> Column:
        out = F.lit(False)
        for p in paths:
            out = out | F.contains(path, F.lit(p))
        for t in terms:
            out = out | F.contains(words, F.lit(t))
        return out

    return (
        F.when(hit(("/judgment", "/judicial-decision")), F.lit("judgment"))
        .when(hit(("/guidance/", "/collection/"), ("guidance",)), F.lit("guidance"))
        .when(hit(("/report", "/research/"), ("report", "research")), F.lit("report"))
        .when(hit(("/publication", "/consultation"), ("publication", "consultation")), F.lit("publication"))
        .otherwise(F.lit("news"))
    )
