"""URL normalisation and document ids.

A URL is valid when it is absolute (``scheme://``) or scheme-relative (``//host``) and well formed. The scheme and
the host are lower-cased; path, query and fragment keep their case, and nothing is removed but a lone trailing ``#``.
Characters a path or fragment may not hold are percent-encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.text import text_or_empty, trim_unicode

# The URL grammar.
_PATH_CHARS = r"A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%"
_PATH_OK = f"^[{_PATH_CHARS}]*$"
_FRAGMENT_OK = f"^[{_PATH_CHARS}?]*$"
_PATH_KEPT = r"^[A-Za-z0-9\-_.~$&+,/:;=@]$"
_FRAGMENT_KEPT = r"^[A-Za-z0-9\-_.~$&+,/:;=@?!()*]$"
_USER_OK = r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*$"
_HOST_OK = r"^(\[[0-9A-Fa-f:.]*\]|(?:[^\x00-\x20\\^`{|}%@\[\]:\x7f]|%[89A-Fa-f][0-9A-Fa-f])*+)(:[0-9]*)?$"
_HOST_PLAIN = r"^[\x21-\x24\x26-\x7e]*$"
_HOST_KEPT = r"^[\x21-\x24\x26-\x7e]$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_CONTROL = r"[\x00-\x1f\x7f]"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# What nearly every absolute link looks like: no character that needs a second look.
_PLAIN = (
    r"^[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]+(:[0-9]+)?"
    r"(/[A-Za-z0-9\-_.~$&+,/:;=@!'()*]*)?(\?[A-Za-z0-9\-_.~$&+,/:;=@!'()*?%]*)?(#[A-Za-z0-9\-_.~$&+,/:;=@!]+)?$"
)
_PLAIN_HEAD = r"^[^/]*//[^/?#]*"

_ID_DROPPED = r"[^A-Za-z0-9_.\-]"
_ID_LENGTH = 100


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _after(text: Column, count: Column) -> Column:
    return F.substr(text, count + 1)


def _percent_decode(part: Column) -> Column:
    return F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _percent_encode(decoded: Column, kept: str) -> Column:
    """Write every character outside ``kept`` as its UTF-8 bytes."""
    encoded = F.transform(
        F.split(decoded, ""),
        lambda c: F.when(c.rlike(kept), c).otherwise(
            F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
        ),
    )
    return F.array_join(encoded, "")


def _encode_if_needed(part: Column, ok: str, kept: str) -> Column:
    return F.when(part.rlike(ok), part).otherwise(_percent_encode(_percent_decode(part), kept))


def _lower_host(host: Column) -> Column:
    return F.when(host.rlike(_HOST_PLAIN), F.lower(host)).otherwise(
        _percent_encode(F.lower(_percent_decode(host)), _HOST_KEPT)
    )


def _any_url(trimmed: Column) -> Column:
    """The general case, for URLs the plain pattern does not cover."""
    no_scheme_host = trimmed.startswith("//")
    absolute = F.when(no_scheme_host, F.concat(F.lit("https:"), trimmed)).otherwise(trimmed)

    def with_parts(u: Column) -> Column:
        body = u["body"]
        return _let(
            F.struct(
                u["fragment"].alias("fragment"),
                F.regexp_extract(body, _SCHEME, 1).alias("scheme"),
                F.when(F.regexp_extract(body, _SCHEME, 0) == "", body)
                .otherwise(_after(body, F.length(F.regexp_extract(body, _SCHEME, 0))))
                .alias("rest"),
            ),
            with_path,
        )

    def with_path(u: Column) -> Column:
        hierarchical = F.substring_index(u["rest"], "?", 1)
        has_host = hierarchical.startswith("//") & (u["scheme"] != "")
        authority = F.when(has_host, F.regexp_extract(hierarchical, r"^//([^/]*)", 1)).otherwise("")
        return _let(
            F.struct(
                u["fragment"].alias("fragment"),
                u["scheme"].alias("scheme"),
                has_host.alias("has_host"),
                F.regexp_extract(authority, r"^(.*@)", 1).alias("user"),
                F.regexp_extract(authority, r"^(?:.*@)?([^@]*)$", 1).alias("host"),
                F.when(has_host, _after(hierarchical, F.length(authority) + 2)).otherwise(hierarchical).alias("path"),
                _after(u["rest"], F.length(hierarchical)).alias("query"),
            ),
            rebuild,
        )

    def rebuild(u: Column) -> Column:
        rootless = ~u["has_host"] & ~u["path"].startswith("/")
        opaque = rootless & (u["scheme"] != "")
        bad_first_segment = rootless & (u["scheme"] == "") & F.substring_index(u["path"], "/", 1).contains(":")
        bad = (
            bad_first_segment
            | u["fragment"].rlike(_BAD_ESCAPE)
            | (~opaque & u["path"].rlike(_BAD_ESCAPE))
            | ~u["user"].rlike(_USER_OK)
            | u["user"].rlike(_BAD_ESCAPE)
            | ~u["host"].rlike(_HOST_OK)
        )
        slashes = u["has_host"] & ((u["host"] != "") | (u["path"] != "") | (u["user"] != ""))
        slashes = slashes | ((u["scheme"] == "") & (u["path"] != ""))
        fragment = F.when(u["fragment"] == "", "").otherwise(
            F.concat(F.lit("#"), _encode_if_needed(u["fragment"], _FRAGMENT_OK, _FRAGMENT_KEPT))
        )
        return F.when(bad, F.lit(None).cast("string")).otherwise(
            F.concat(
                F.when(u["scheme"] == "", "https").otherwise(F.lower(u["scheme"])),
                F.lit(":"),
                F.when(slashes, "//").otherwise(""),
                u["user"],
                _lower_host(u["host"]),
                F.when(opaque, u["path"]).otherwise(_encode_if_needed(u["path"], _PATH_OK, _PATH_KEPT)),
                u["query"],
                fragment,
            )
        )

    body = F.substring_index(absolute, "#", 1)
    return _let(F.struct(body.alias("body"), _after(absolute, F.length(body) + 1).alias("fragment")), with_parts)


def _normalize_trimmed(trimmed: Column) -> Column:
    head = F.regexp_extract(trimmed, _PLAIN_HEAD, 0)
    return (
        F.when(~trimmed.contains("://") & ~trimmed.startswith("//"), F.lit(None).cast("string"))
        .when(trimmed.rlike(_PLAIN), F.concat(F.lower(head), _after(trimmed, F.length(head))))
        .when(trimmed.rlike(_CONTROL), F.lit(None).cast("string"))
        .otherwise(_any_url(trimmed))
    )


def _once(build: Callable[[Column | str], Column]) -> Callable[[Column | str], Column]:
    """One expression for each column name: to build these takes thousands of calls to the JVM, for every micro-batch anew."""
    made: dict[tuple, Column] = {}

    @wraps(build)
    def get(col: Column | str) -> Column:
        if not isinstance(col, str):
            return build(col)
        place = col, id(SparkContext._gateway)
        if place not in made:
            made[place] = build(col)
        return made[place]

    return get


@_once
def normalize_url(col: Column | str) -> Column:
    """The normalised URL, or null when the URL is invalid."""
    return _normalize_trimmed(trim_unicode(col))


@_once
def normalize_links(col: Column | str) -> Column:
    """Normalise every link, keep order and repeats, drop invalid ones; null when none is left."""
    links = F.col(col) if isinstance(col, str) else col
    normalized = F.transform(F.transform(links, trim_unicode), _normalize_trimmed)
    kept = F.filter(normalized, lambda link: link.isNotNull())
    # the array itself is an element that passes or not, so that it is computed once
    return F.get(F.filter(F.array(kept), lambda links: F.size(links) > 0), 0)


def sanitize_id(col: Column | str) -> Column:
    """An index id: protocols removed, separators to ``_``, other special characters dropped, at most 100 long."""
    raw = text_or_empty(col)
    bare = F.replace(F.replace(raw, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return F.substring(F.regexp_replace(F.translate(bare, "/?&=# :", "_______"), _ID_DROPPED, ""), 1, _ID_LENGTH)


def doc_id(url: Column | str, canonical_url: Column | str) -> Column:
    """The document id: from the canonical URL unless that is blank, else from the URL."""
    return sanitize_id(F.when(trim_unicode(canonical_url) != "", text_or_empty(canonical_url)).otherwise(text_or_empty(url)))
