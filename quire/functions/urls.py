"""URL functions as column expressions: never raise, null in gives null out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: scheme, host with port, path, query.
URL = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?"
LANGUAGE_PATHS = {"en": ("/en/", "lang=en"), "fr": ("/fr/", "lang=fr"), "de": ("/de/", "lang=de"), "es": ("/es/", "lang=es")}


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def normalise(url: Column, keep_query: bool = True) -> Column:
    """Lower-case scheme and host, no fragment, no slash at the end of the path, query pairs sorted and blank ones dropped."""
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.regexp_replace(part(url, 3), "/+$", ""))
    if not keep_query:
        return base
    pairs = F.filter(F.array_sort(F.split(part(url, 4), "&")), lambda p: p.rlike("=."))
    return F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def extension(url: Column) -> Column:
    """Of the path's last part, lower-cased and without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(part(url, 3), "[^/.]+[.]([^./]+)$", 1))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute URL without fragment; dot segments stay."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def valid_link(url: Column, domains: Sequence[str] = (), ignored: Sequence[str] = (), strict: bool = False) -> Column:
    """Scheme http or https, host ending in an allowed domain (``strict``: at a dot), extension not ignored."""
    ok = F.lower(part(url, 1)).isin("http", "https") & (host(url) != "")
    if domains:
        fits = F.lit(False)
        for d in domains:
            fits = fits | ((host(url) == d) | host(url).endswith("." + d) if strict else host(url).endswith(d))
        ok = ok & fits
    if ignored:
        ok = ok & ~extension(url).isin(*[e.lstrip(".").lower() for e in ignored])
    return F.coalesce(ok, F.lit(False))


def language_gate(url: Column, languages: Sequence[str], patterns: dict[str, Sequence[str]] = LANGUAGE_PATHS) -> Column:
    """Whether the URL has a pattern of one of the languages, or no language is asked for."""
    if not languages:
        return F.lit(True)
    wanted = [p for code in languages for p in (*patterns.get(code, ()), f"/{code}/")]
    found = F.lit(False)
    for p in dict.fromkeys(wanted):
        found = found | F.lower(url).contains(p)
    return F.coalesce(found, F.lit(False))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)
