"""Typing of HTTP paths in route rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HTTP_METHODS, QUOTED_HEAD

# A leading slash, then segments of plain characters, none empty but the last.
PLAIN_PREFIX = r"^/([a-zA-Z0-9._-]+/)*[a-zA-Z0-9._-]*\z"


def known_method(method: Column) -> Column:
    return method.isin(*HTTP_METHODS)


def path_prefix(pattern: Column) -> Column:
    """Literal path a service pattern begins with, less one trailing slash; null if it has none.

    ``\\Q/api/\\E([^/]+)`` gives ``/api``, ``\\Q/\\E`` gives the empty text.
    """
    head = F.regexp_extract(pattern, QUOTED_HEAD, 1)
    return F.when(head != "", F.regexp_replace(head, r"/\z", ""))


def typed_path(path: Column, is_regex: Column) -> Column:
    """``struct<kind, value, error>`` of a rule's path.

    Plain text is a ``path``. A regex that starts with ``^/`` and does not end with ``$`` is a
    ``path-beg`` without its ``^`` and must be a plain prefix; any other is a ``path-regex``.
    """
    is_regex = F.coalesce(is_regex, F.lit(False))
    begins = is_regex & path.startswith("^/") & ~path.endswith("$")
    prefix = F.substr(path, F.lit(2))
    plain = prefix.rlike(PLAIN_PREFIX)
    kind = F.when(~is_regex, F.lit("path")).when(
        begins, F.when(plain, F.lit("path-beg"))
    ).otherwise(F.lit("path-regex"))
    value = F.when(~begins, path).when(plain, prefix)
    error = F.when(begins & ~plain, F.concat(path, F.lit(" is not a plain path prefix")))
    return F.struct(kind.alias("kind"), value.alias("value"), error.alias("error"))


def pair_request(first: Column, second: Column) -> Column:
    """Request rule written as two texts: method and path if the first is a method, else path and rewrite."""
    method = known_method(first)
    return F.struct(
        F.when(method, first).alias("method"),
        F.when(method, second).otherwise(first).alias("path"),
        F.lit(False).alias("is_regex"),
        F.when(~method, second).alias("rewrite"),
    )


def tuple_request(texts: Column, regex_at: Column) -> Column:
    """Request rule written as one to three texts, of which the one at ``regex_at`` (from 0, null for none) is a regex.

    One text is a path. Of two, a regex makes clear what the other is: a method before it or a
    rewrite after it; without one they are told apart as in :func:`pair_request`. Three are method,
    path and rewrite.
    """
    text = lambda i: F.try_element_at(texts, F.lit(i + 1))
    size, at = F.size(texts), F.coalesce(regex_at, F.lit(-1))
    pair = pair_request(text(0), text(1))
    path_second = (size == 3) | (at == 1)
    plain_pair = (size == 2) & (at < 0)
    return F.struct(
        F.when(plain_pair, pair["method"]).when(path_second, text(0)).alias("method"),
        F.when(plain_pair, pair["path"]).when(path_second, text(1)).otherwise(text(0)).alias("path"),
        (at >= 0).alias("is_regex"),
        F.when(plain_pair, pair["rewrite"]).when(size == 3, text(2)).when((size == 2) & (at == 0), text(1)).alias("rewrite"),
    )


def typed_request(request: Column) -> Column:
    """Manifest form of a request struct: one of ``path``, ``path-beg``, ``path-regex``, then method and rewrite."""
    typed = typed_path(request["path"], request["is_regex"])
    kinds = [
        F.when(typed["kind"] == kind, typed["value"]).alias(kind)
        for kind in ("path", "path-beg", "path-regex")
    ]
    return F.struct(*kinds, request["method"].alias("method"), request["rewrite"].alias("rewrite"))
