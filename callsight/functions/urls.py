"""URL expressions: parsing, normalising, path patterns, link resolution.

URLs are read with one hierarchical pattern (``scheme://authority/path?query``)
and follow browser rules for the parts the reports depend on: hosts in lower
case without their default port, paths with unsafe characters percent-encoded
and dot segments resolved. International host names keep their Unicode form.

Functions that need more than one part take an optional ``parts`` column. A
DataFrame that adds ``url_parts(url)`` once and passes it on parses each URL once.
What :func:`bind` holds is interpreted, not compiled: a table of many URLs adds the
steps (``url_fields``, ``parts_of``, ``sorted_fields``, ...) as columns, one upon the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.memo import reused

_URL = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_FIELDS = "$1\x01$2\x01$3\x01$4"
_HOST = r"^(\[[0-9a-f:.]+\]|[^\s:\[\]<>^|%]+)(:[0-9]*)?$"
_PLAIN_HOST = r"""^[a-z0-9.\-]++\z"""
# ``scheme|host:port`` without the port the scheme implies.
_DEFAULT_PORT = r"^(?:(?:https|wss)\|(.*?):(?:443)?|(?:http|ws)\|(.*?):(?:80)?|[^|]*\|(.*?):?)$"
_CLEAN_PATH = r"""^(?!.*/(?:\.|%2[eE]){1,2}(?:/|$))/[!$-;=@-_a-z|~&%]*$"""
_SAFE_PATH = r"""^/[!$-;=@-_a-z|~&%]*+$"""  # clean where no segment begins with a dot
# Already as :func:`normalize_url` writes it.
_PLAIN_URL = r"""^(?:https?|wss?)://[a-z0-9.\-]+(?:/[A-Za-z0-9_~\-][A-Za-z0-9_.~\-]*+){1,64}+\z"""
# Fields that are neither decoded nor encoded, each with a name.
_PLAIN_QUERY = r"""^[A-Za-z0-9_.*\-]+=[A-Za-z0-9_.*\-]*+(?:&[A-Za-z0-9_.*\-]+=[A-Za-z0-9_.*\-]*+)*+\z"""
_TRACKING_FIELD = rf"""(?:{fv.TRACKING_PARAM.replace("^", "(?<![^&])").replace("$", "(?==)")})[^&]*+&?"""
_REPEATED_NAME = r"""(?<![^&])([^&\x01]++)\x01[^&]*+&\1\x01"""  # of sorted fields
_UNSAFE_PATH = r"""[^!-~]|["#<>?`{}]"""
_UNSAFE_QUERY = r"""[^!-~]|["#<>']"""

_MAY_HOLD_ID = r"[0-9]|[a-fA-F]{8}"
_LINE_ENDS = "\n\r\x85\u2028\u2029"  # before these an expression also sees the end of the text
_ONE_MARK = r"^([^\x01]*+)\x01([^\x01]*+)\z"
_TWO_MARKS = r"^([^\x01]*+)\x01([^\x01]*+)\x01([^\x01]*+)\z"
ID_SEGMENT = (
    rf"(?:{fv.NUMERIC_ID}|{fv.UUID}|{fv.HEX_ID}|(?=[A-Za-z_-]*[0-9]){fv.OPAQUE_ID})"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """Generator of the value, dropping rows where it is null.

    Unlike a filter on a new column, which Spark evaluates again below the projection, this
    computes an expensive value once.
    """
    return F.explode(F.array_compact(F.array(value)))


def _percent_encode(text: Column, unsafe: str) -> Column:
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
            lambda ch: F.when(ch.rlike(unsafe), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _resolve_dots(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg.rlike(r"(?i)^(\.|%2e){2}$"),
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        )
        .when(seg.rlike(r"(?i)^(\.|%2e)$"), acc)
        .otherwise(F.array_append(acc, seg)),
    )
    closing = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.array_join(kept, "/"), closing), r"^(?!/)", "/")


def clean_path(path: Column) -> Column:
    """A pathname as a browser reports it: rooted, encoded, without dot segments."""
    slashed = F.translate(path, "\\", "/")
    rebuilt = bind(slashed, lambda text: bind(_percent_encode(text, _UNSAFE_PATH), _resolve_dots))
    # Each test is tried only where the cheaper ones before it fail.
    safe = F.when(path.contains("/.") | path.contains("/%2"), path.rlike(_CLEAN_PATH)).otherwise(path.rlike(_SAFE_PATH))
    return F.when(path == "", F.lit("/")).when(safe, path).otherwise(rebuilt)


def _lowered(text: Column) -> Column:
    return F.when(text.rlike(r"[A-Z]|[^\x00-\x7F]"), F.lower(text)).otherwise(text)


def url_fields(url: Column | str) -> Column:
    """Scheme, authority, path and query as written; another number of fields when the text is not a URL."""
    return F.split(F.regexp_replace(_col(url), _URL, _FIELDS), "\x01")


def parts_of(found: Column) -> Column:
    """:func:`url_parts` of the fields of a URL."""
    authority = F.get(found, F.lit(1))
    # Most authorities are a host alone, in lower case.
    plain = authority.rlike(_PLAIN_HOST)
    scheme = _lowered(F.get(found, F.lit(0)))
    named = F.when(plain, authority).otherwise(F.lower(F.regexp_replace(authority, r"^.*@", "")))
    site = F.regexp_replace(F.concat(scheme, F.lit("|"), named), _DEFAULT_PORT, "$1$2$3")
    return F.when(
        (F.size(found) == 4) & F.when(plain, F.lit(True)).otherwise(named.rlike(_HOST)),
        F.struct(
            scheme.alias("scheme"),
            F.when(authority.contains("@"), F.regexp_extract(authority, r"^(.*)@", 1)).otherwise(F.lit("")).alias("userinfo"),
            F.when(plain, authority).otherwise(site).alias("host"),
            clean_path(F.get(found, F.lit(2))).alias("path"),
            F.get(found, F.lit(3)).alias("query"),
        ),
    )


@reused
def url_parts(url: Column | str) -> Column:
    """``struct(scheme, userinfo, host, path, query)``; null when the text is not a URL."""
    return bind(url_fields(url), parts_of)


@reused
def url_host(url: Column | str) -> Column:
    """Host with its non-default port, null when invalid."""
    return url_parts(url)["host"]


@reused
def url_path(url: Column | str) -> Column:
    return url_parts(url)["path"]


@reused
def url_origin(url: Column | str, parts: Column | None = None) -> Column:
    """``scheme://host``, or the text itself when it is not a URL."""
    site = lambda found: F.concat(found["scheme"], F.lit("://"), found["host"])
    return F.coalesce(site(parts) if parts is not None else bind(url_parts(url), site), _col(url))


def form_decode(text: Column) -> Column:
    return F.when(text.contains("%") | text.contains("+"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)


def query_entries(query: Column) -> Column:
    """Ordered ``array<struct(name, value)>`` of a query string, decoded."""
    return F.transform(
        F.filter(F.split(query, "&"), lambda item: item != ""),
        lambda item: F.struct(
            form_decode(F.substring_index(item, "=", 1)).alias("name"),
            form_decode(F.substr(item, F.length(F.substring_index(item, "=", 1)) + 2)).alias("value"),
        ),
    )


def sorted_fields(query: Column) -> Column:
    """The fields of a plain query in order, without tracking parameters, ``\x01`` for ``=``; null where the query is not plain."""
    fields = F.split(F.translate(F.regexp_replace(query, _TRACKING_FIELD, ""), "=", "\x01"), "&")
    return F.when(query.rlike(_PLAIN_QUERY), F.array_join(F.sort_array(F.array_remove(fields, "")), "&"))


@reused
def normalize_url(url: Column | str, parts: Column | None = None, fields: Column | None = None) -> Column:
    """Deduplication form: no fragment, no tracking parameters, sorted parameters, no trailing slash.

    ``fields`` are the :func:`sorted_fields` of the query of ``parts``.
    """
    url = _col(url)

    def joined(text: Column) -> Column:
        """A plain query; null where a name comes twice, whose fields keep their order."""
        return F.when(~text.rlike(_REPEATED_NAME), F.translate(text, "\x01", "="))

    def rebuilt(found: Column) -> Column:
        kept = F.filter(query_entries(found["query"]), lambda entry: ~entry["name"].rlike(fv.TRACKING_PARAM))
        ordered = F.sort_array(
            F.transform(
                kept,
                lambda entry, at: F.struct(
                    entry["name"].alias("name"),
                    at.alias("at"),
                    F.concat(F.url_encode(entry["name"]), F.lit("="), F.url_encode(entry["value"])).alias("text"),
                ),
            )
        )
        query = F.coalesce(
            joined(fields) if fields is not None else bind(sorted_fields(found["query"]), joined),
            F.array_join(F.transform(ordered, lambda entry: entry["text"]), "&"),
        )
        path = found["path"]
        return F.concat(
            found["scheme"],
            F.lit("://"),
            F.when(found["userinfo"] == "", F.lit("")).otherwise(F.regexp_replace(found["userinfo"], r"(?<=.)$", "@")),
            found["host"],
            # A trailing slash goes unless it is the whole path.
            F.when(path.rlike(r"/\z|\n"), F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"^$", "/")).otherwise(path),
            F.when(found["query"] == "", F.lit("")).otherwise(F.regexp_replace(query, r"^(?=.)", "?")),
        )

    found = rebuilt(parts) if parts is not None else F.when(~url.rlike(_PLAIN_URL), bind(url_parts(url), rebuilt))
    return F.coalesce(found, url)


@reused
def looks_like_id(segment: Column | str) -> Column:
    return _col(segment).rlike(rf"^{ID_SEGMENT}$")


def trimmed_path(path: Column) -> Column:
    """A path without repeated slashes and without a slash at its end."""
    single = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"(?<=.)/$", "")
    return F.when(path.contains("//") | path.endswith("/") | path.contains("\n"), single).otherwise(path)


def marked_path(text: Column) -> Column:
    """A trimmed path with ``{id}`` and ``{id2}`` for up to two identifiers; ``\x01`` stays in place of three or more.

    Null where the identifiers must be looked for segment by segment.
    """
    marked = F.regexp_replace(text, rf"/{ID_SEGMENT}(?=/|$)", "/\x01")
    named = F.regexp_replace(F.regexp_replace(marked, _TWO_MARKS, "$1{id}$2{id2}$3"), _ONE_MARK, "$1{id}$2")
    mistaken = reduce(lambda left, right: left | right, [text.contains(mark) for mark in "\x01" + _LINE_ENDS])
    return F.when(~text.rlike(_MAY_HOLD_ID), text).when(text.startswith("/") & ~mistaken, named)


def pattern_of(text: Column, marked: Column) -> Column:
    """:func:`path_pattern` of a trimmed path and its :func:`marked_path`."""
    numbered = F.aggregate(
        F.split(F.substring(text, 2, 1 << 30), "/"),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("ids")),
        lambda acc, seg: bind(
            looks_like_id(seg),
            lambda found: F.struct(
                F.concat(
                    acc["text"],
                    F.when(~found, F.concat(F.lit("/"), seg))
                    .when(acc["ids"] == 0, F.lit("/{id}"))
                    .otherwise(F.concat(F.lit("/{id"), (acc["ids"] + 1).cast("string"), F.lit("}"))),
                ).alias("text"),
                (acc["ids"] + found.cast("int")).alias("ids"),
            ),
        ),
        lambda acc: acc["text"],
    )
    single = F.regexp_replace(text, rf"/{ID_SEGMENT}(?=/|$)", "/{id}")
    several = text.rlike(rf"/{ID_SEGMENT}(?:/|$)(?:.*/)?{ID_SEGMENT}(?:/|$)")
    return F.when(~marked.contains("\x01"), marked).when(several, numbered).otherwise(single)


def path_pattern(path: Column) -> Column:
    """``/orders/42/items/7`` -> ``/orders/{id}/items/{id2}``.

    Regular expressions cover paths with at most two identifiers; only the
    others pay for the fold that numbers the placeholders.
    """
    return bind(trimmed_path(path), lambda text: bind(marked_path(text), lambda marked: pattern_of(text, marked)))


@reused
def url_pattern(url: Column | str) -> Column:
    """Path pattern of a URL; host and query are ignored, invalid text is kept."""
    url = _col(url)
    return F.coalesce(path_pattern(url_parts(url)["path"]), url)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_domain(left: Column | str, right: Column | str) -> Column:
    """Equal ``host:port`` ignoring a leading ``www.``; false when either is not a URL."""
    return F.coalesce(bare_host(url_host(left)) == bare_host(url_host(right)), F.lit(False))


@reused
def is_private_host(url_or_host: Column | str) -> Column:
    text = _col(url_or_host)
    host = F.regexp_replace(F.lower(F.coalesce(url_host(text), text)), r":[0-9]+$", "")
    return bind(
        host,
        lambda name: name.isin(fv.PRIVATE_HOSTS)
        | name.rlike(r"\.(local|internal)$")
        | name.rlike(r"^(127|10|192\.168)\.")
        | name.rlike(r"^172\.0*(1[6-9]|2[0-9]|3[01])\."),
    )


@reused
def path_params(pattern: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(pattern), F.lit(r"\{([^}]+)\}"), F.lit(1)))


@reused
def operation_id(method: Column | str, pattern: Column | str) -> Column:
    named = F.regexp_replace(_col(pattern), r"\{([^}]+)\}", "by-$1")
    return F.concat(
        F.lower(_col(method)),
        F.regexp_replace(F.regexp_replace(named, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""),
    )


@reused
def page_label(url: Column | str, seed_url: Column | str, parts: Column | None = None) -> Column:
    """Path and query of a page, with its host in front when it is not the seed's."""
    url = _col(url)

    def label(found: Column) -> Column:
        at_home = F.coalesce(found["host"] == url_host(seed_url), F.lit(False))
        return F.concat(
            F.when(at_home, F.lit("")).otherwise(found["host"]),
            found["path"],
            F.regexp_replace(found["query"], r"(?s)^(?=.)", "?"),
        )

    return F.coalesce(label(parts) if parts is not None else bind(url_parts(url), label), url)


@reused
def link_targets(html: Column | str) -> Column:
    """Raw ``href`` values of the anchors in a page, in order."""
    return F.regexp_extract_all(_col(html), F.lit(fv.ANCHOR_HREF), F.lit(1))


@reused
def resolve_link(href: Column | str, base: Column | str, base_parts: Column | None = None) -> Column:
    """An absolute URL for ``href`` as found on page ``base``; null when neither yields one."""
    href = _col(href)

    def absolute(found: Column) -> Column:
        site = F.concat(found["scheme"], F.lit("://"), found["host"])
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(found["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(site, href))
            .when(href.startswith("?"), F.concat(site, found["path"], href))
            .otherwise(F.concat(site, F.regexp_replace(found["path"], r"[^/]*$", ""), href))
        )

    return absolute(base_parts) if base_parts is not None else bind(url_parts(base), absolute)


@reused
def serialize_url(url: Column | str, parts: Column | None = None) -> Column:
    """The text a browser shows for a parsed URL; other schemes (``mailto:``) are kept as they are."""
    url = _col(url)

    def text(found: Column) -> Column:
        query = _percent_encode(found["query"], _UNSAFE_QUERY)
        return F.concat(
            found["scheme"],
            F.lit("://"),
            F.regexp_replace(found["userinfo"], r"(?<=.)$", "@"),
            found["host"],
            found["path"],
            F.regexp_replace(query, r"(?s)^(?=.)", "?"),
        )

    opaque = F.when(url.rlike(r"^(?!(?i:https?|wss?|ftp):)[A-Za-z][A-Za-z0-9+.\-]*:"), url)
    return F.coalesce(text(parts) if parts is not None else bind(url_parts(url), text), opaque)


@reused
def has_param(path: Column | str) -> Column:
    return _col(path).rlike(r"(^|/)\{[^/]+\}(/|$)")


@reused
def is_item(path: Column | str) -> Column:
    return _col(path).rlike(r"(^|/)\{[^/]+\}/*$")


@reused
def collection_root(pattern: Column | str) -> Column:
    """Everything before the first parameter; the path itself when it has none or starts with one."""
    pattern = _col(pattern)
    root = F.regexp_extract(pattern, r"^((?:/(?!\{[^/]+\}(?:/|$))[^/]+)+)/\{[^/]+\}(?:/.*)?$", 1)
    return F.when(pattern == "", F.lit("/")).when(root != "", root).otherwise(pattern)
