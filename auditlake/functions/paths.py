"""File paths and addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """One spelling of a path: no white space around it, ``/`` only, no empty, ``.`` or ``..`` step.

    Steps are only walked where the spelling needs it. ``..`` above the first step is dropped.
    """
    plain = F.translate(F.btrim(path, F.lit(" \t\n\x0b\f\r")), "\\", "/")
    steps = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda kept, step: F.when((step == "") | (step == "."), kept)
        .when(step == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.concat(kept, F.array(step))),
    )
    # plain substring tests stay in generated code; no expression engine runs for a path that is fine
    odd = plain.contains("//") | plain.contains("/./") | plain.contains("/../") | plain.isin("", ".", "..")
    for edge in ("/", "./", "../"):
        odd = odd | plain.startswith(edge)
    for edge in ("/", "/.", "/.."):
        odd = odd | plain.endswith(edge)
    return F.when(odd, F.array_join(steps, "/")).otherwise(plain)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def ancestors(path: Column) -> Column:
    """Every directory above a path, the root as the empty string, so a longest-prefix join becomes an equi join."""
    steps = F.split(directory(path), "/")
    return F.transform(F.sequence(F.lit(0), F.when(directory(path) == "", F.lit(0)).otherwise(F.size(steps))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def normal_url(url: Column) -> Column:
    """An address without fragment, tracking parameters and trailing slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    tracked = F.regexp_replace(F.regexp_replace(bare, r"(?i)([?&])(?:utm_[a-z]+|fbclid|gclid)=[^&]*", "$1"), r"&{2,}", "&")
    clean = F.regexp_replace(F.regexp_replace(tracked, r"\?&", "?"), r"[?&]+$", "")
    return F.regexp_replace(clean, r"(?<=[^/:])/+$", "")


def comparable_url(url: Column) -> Column:
    """Origin and path in lower case, without query and trailing slash."""
    return F.regexp_replace(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"/+$", "")


def url_path(url: Column) -> Column:
    """Path and query of an address; ``/`` for none."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*([^#]*)", 1)
    relative = F.when(url.rlike(r"^(?:[a-zA-Z][\w+.-]*:)?//"), path).otherwise(F.regexp_replace(url, "#.*$", ""))
    return F.when(relative == "", "/").otherwise(relative)


def short_name(url: Column) -> Column:
    """The last step of an address, without its query; the host if there is no step."""
    steps = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda s: s != "")
    return F.element_at(steps, F.lit(-1))


def normal_route(raw: Column) -> Column:
    """A route with one leading slash, none behind or doubled, without query and fragment; ``/`` for nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[?#].*$", ""), r"/{2,}", "/")
    lead = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(F.length(lead) > 1, F.regexp_replace(lead, "/+$", "")).otherwise(lead)


def route_regex(pattern: Column) -> Column:
    """An anchored expression of a route: ``:id``, ``{id}``, ``<int:id>``, ``[id]`` take one step, ``*`` and ``[...x]`` any."""
    p = F.regexp_replace(pattern, r"([.+^$()|\\])", r"\\$1")
    p = F.regexp_replace(p, r"\[\\\.\\\.\\\.[^\]]*\]|\*\*?|\{[^}]*\\\+?\*[^}]*\}", "\u0001")
    p = F.regexp_replace(p, r":[A-Za-z_]\w*\??|\{[^}]*\}|<[^>]*>|\[[^\]]*\]", "[^/]+")
    return F.concat(F.lit("^"), F.replace(p, F.lit("\u0001"), F.lit(".*")), F.lit("/?$"))


def file_route(path: Column) -> Column:
    """The route that a file of a pages, routes or app folder serves: index vanishes, [slug] is :slug, [...all] is *, groups in brackets vanish."""
    p = F.regexp_replace(path, r"\.[^./]+$", "")
    p = F.regexp_replace(p, r"(^|/)\([^)]*\)(?=/|$)", "$1")
    p = F.regexp_replace(p, r"(^|/)(?:index|page|\+page)$", "$1")
    p = F.regexp_replace(F.regexp_replace(p, r"\[\[?\.\.\.[^\]]*\]?\]", "*"), r"\[\[?([^\[\]]+)\]?\]", ":$1")
    return normal_route(p)
