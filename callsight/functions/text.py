"""Scalar expressions over text, headers and bodies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.memo import reused
from callsight.functions.urls import bind


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- headers -------------------------------------------------------------------


@reused
def header_value(headers: Column | str, name: str) -> Column:
    """Case-insensitive header lookup; an exact lower-case name wins."""
    headers = _col(headers)
    any_case = F.map_values(F.map_filter(headers, lambda key, _: F.lower(key) == name))
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.get(any_case, F.lit(0)))


@reused
def has_header(headers: Column | str, name: str) -> Column:
    return F.coalesce(F.exists(F.map_keys(_col(headers)), lambda key: F.lower(key) == name), F.lit(False))


@reused
def cache_info(headers: Column | str) -> Column:
    """Caching headers as a struct, null when a response says nothing about caching."""
    fields = {
        "control": header_value(headers, "cache-control"),
        "etag": header_value(headers, "etag"),
        "last_modified": header_value(headers, "last-modified"),
        "age": _numeric_text(header_value(headers, "age")),
        "vary": header_value(headers, "vary"),
        "status": F.coalesce(header_value(headers, "x-cache"), header_value(headers, "cf-cache-status")),
    }
    found = F.struct(*[value.alias(name) for name, value in fields.items()])
    said = lambda info: reduce(lambda left, right: left | right, [info[name].isNotNull() for name in fields])
    return F.get(F.filter(F.array(found), said), F.lit(0))


_CACHE_HEADERS = ["cache-control", "etag", "last-modified", "vary", "x-cache", "cf-cache-status"]


@reused
def has_cache_info(headers: Column | str) -> Column:
    """Does a response say anything about caching? The headers are only read one by one where a look at them leaves it open."""
    headers = _col(headers)
    says = F.exists(F.map_keys(headers), lambda key: F.lower(key).isin(_CACHE_HEADERS))
    whole = F.forall(F.map_values(headers), lambda value: value.isNotNull())
    return (says & whole) | cache_info(headers).isNotNull()


def _numeric_text(text: Column) -> Column:
    """A finite number written as text; blank text counts as zero."""
    number = F.when(F.trim(text) == "", F.lit(0.0)).when(
        text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double")
    )
    return F.when(F.abs(number) < float("inf"), number)


# --- bodies --------------------------------------------------------------------


@reused
def bare_mime(mime: Column | str) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(_col(mime), F.lit("")), ";", 1)))


@reused
def is_binary_mime(mime: Column | str) -> Column:
    bare = bare_mime(mime)
    return bare.rlike(fv.BINARY_MIME_PREFIX) | bare.isin(fv.BINARY_MIMES)


@reused
def json_container(body: Column | str) -> Column:
    """Parsed body when it is a JSON object or array, else null."""
    body = _col(body)
    return F.when(body.rlike(r"^\s*[{\[]"), F.try_parse_json(body))


@reused
def body_gap(body: Column | str, truncated: Column | str | bool = False) -> Column:
    """Why a captured body has no (complete) shape; null when it has one."""
    cut = F.lit(truncated) if isinstance(truncated, bool) else F.coalesce(_col(truncated), F.lit(False))
    return F.when(cut, F.lit("truncated")).when(json_container(body).isNull(), F.lit("not-json"))


@reused
def absent_body_gap(mime: Column | str) -> Column:
    bare = bare_mime(mime)
    return (
        F.when(is_binary_mime(mime), F.lit("binary"))
        .when((bare == "") | bare.contains("json"), F.lit("no-body"))
        .otherwise(F.lit("not-json"))
    )


@reused
def response_gap(body: Column | str, truncated: Column | str | bool, mime: Column | str) -> Column:
    return F.when(_col(body).isNotNull(), body_gap(body, truncated)).otherwise(absent_body_gap(mime))


@reused
def request_gap(body: Column | str) -> Column:
    return F.when(_col(body).isNotNull(), body_gap(body)).otherwise(F.lit("no-body"))


def gap_rank(reason: Column) -> Column:
    """Weight of a gap reason, so the strongest survives a ``max``; null stays null."""
    # Null for a null reason by itself; asking for it would work out the reason, and read a body, once more.
    return F.array_position(F.array(*[F.lit(r) for r in fv.GAP_REASONS]), reason).cast("int")


def gap_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(r) for r in fv.GAP_REASONS]), F.greatest(rank, F.lit(1))))


def gap_phrase(reason: Column) -> Column:
    phrase = F.create_map(*[F.lit(x) for pair in fv.GAP_PHRASES.items() for x in pair])
    return F.try_element_at(phrase, reason)


# --- string formats ------------------------------------------------------------


@reused
def string_format(value: Column | str) -> Column:
    """Well-known shape of a string value, null for prose."""
    value = _col(value)
    chain = None
    for name, pattern in fv.STRING_FORMATS:
        # ``\z`` ends at the very end; ``$`` would also accept a final line break.
        test = value.rlike(re.sub(r"\$$", r"\\z", pattern))
        if name == "currency":
            test = value.isin(fv.CURRENCY_CODES) | test
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


@reused
def is_enum_member(value: Column | str, fmt: Column | None = None, longest: int = fv.MAX_ENUM_LENGTH) -> Column:
    """Short text without white space or a format of its own."""
    value = _col(value)
    fmt = string_format(value) if fmt is None else fmt
    return F.length(value).between(1, longest) & ~value.rlike(r"\s") & fmt.isNull()


def infer_scalar_type(values: Column) -> Column:
    """OpenAPI type of a parameter's sample values."""
    some = F.size(values) > 0
    return (
        F.when(some & F.forall(values, lambda v: v.rlike(r"^-?[0-9]+$")), F.lit("integer"))
        .when(some & F.forall(values, lambda v: v.rlike(r"^-?[0-9]*\.[0-9]+$")), F.lit("number"))
        .when(some & F.forall(values, lambda v: v.isin("true", "false")), F.lit("boolean"))
        .otherwise(F.lit("string"))
    )


# --- sensitive names and values ------------------------------------------------

# An address is only tried where its local part can begin; otherwise a long run of letters
# would be read once per letter.
EMAIL_ANYWHERE = rf"(?<![A-Za-z0-9._%+-]){fv.EMAIL_TEXT}"

# Every sensitive value has a digit, an @ or the beginning of a token; most values have none and need no other test.
_MAY_BE_SENSITIVE = r"[0-9@]|^eyJ"


@reused
def is_sensitive_header(name: Column | str) -> Column:
    return F.lower(_col(name)).isin(fv.SENSITIVE_HEADERS)


@reused
def is_sensitive_key(key: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(_col(key)), r"[^a-z0-9]", "")
    return plain.rlike("|".join(fv.SENSITIVE_KEYS))


@reused
def is_sensitive_param(name: Column | str) -> Column:
    spaced = F.lower(F.regexp_replace(_col(name), r"([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.split(spaced, r"[^a-z0-9]+"), lambda word: word != "")
    listed = F.array(*[F.lit(word) for word in fv.SENSITIVE_PARAM_WORDS])
    return F.arrays_overlap(words, listed) | F.array_join(words, "").isin(fv.SENSITIVE_PARAM_WORDS)


@reused
def entropy_per_char(value: Column | str) -> Column:
    """Shannon entropy in bits per character."""
    value = _col(value)
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    total = F.length(value).cast("double")
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda bits, ch: bits
        - (F.length(value) - F.length(F.replace(value, ch, F.lit("")))) / F.length(ch) / total
        * F.log2((F.length(value) - F.length(F.replace(value, ch, F.lit("")))) / F.length(ch) / total),
    )


@reused
def looks_like_secret(value: Column | str) -> Column:
    value = _col(value)
    spelled = (
        (F.length(value) >= fv.SECRET_MIN_LENGTH)
        & (value.rlike(fv.BASE64_VALUE) | value.rlike(fv.BASE64URL_VALUE))
        & value.rlike("[A-Za-z]")
        & value.rlike("[0-9]")
    )
    # CASE keeps the character count off the values the cheap tests already rule out.
    return F.when(spelled, entropy_per_char(value) >= fv.SECRET_MIN_ENTROPY).otherwise(F.lit(False))


@reused
def looks_like_phone(value: Column | str) -> Column:
    value = _col(value)
    digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    return value.rlike(fv.PHONE_VALUE) & (digits >= fv.PHONE_MIN_DIGITS) & value.rlike(r"(?s)^.+[ ().-].*.$")


@reused
def is_sensitive_scalar(value: Column | str) -> Column:
    """The whole value is a token, email, national id, phone number or random-looking secret."""
    return bind(_trim(_col(value)), _is_sensitive_trimmed)


def _is_sensitive_trimmed(text: Column) -> Column:
    tests = (
        text.rlike(fv.JWT_VALUE)
        | text.rlike(f"^{fv.EMAIL_TEXT}$")
        | text.rlike(f"^{fv.SSN_TEXT}$")
        | looks_like_phone(text)
        | looks_like_secret(text)
    )
    return F.when(text.isNull() | text.rlike(_MAY_BE_SENSITIVE), tests).otherwise(F.lit(False))


@reused
def is_sensitive_value(value: Column | str) -> Column:
    """Like :func:`is_sensitive_scalar`, and an email or national id anywhere in the text."""
    anywhere = lambda text: text.contains("@") & text.rlike(EMAIL_ANYWHERE) | text.rlike(rf"\b{fv.SSN_TEXT}\b")
    tests = lambda text: _is_sensitive_trimmed(text) | anywhere(text)
    return bind(
        _trim(_col(value)), lambda text: F.when(text.isNull() | text.rlike(_MAY_BE_SENSITIVE), tests(text)).otherwise(F.lit(False))
    )


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


@reused
def redact_log_line(line: Column | str) -> Column:
    masked = F.regexp_replace(_col(line), fv.LOG_ASSIGNMENT, f"$1={fv.REDACTED}")
    masked = F.regexp_replace(masked, fv.LOG_BEARER, f"Bearer {fv.REDACTED}")
    return F.regexp_replace(masked, fv.LOG_JWT, f"JWT {fv.REDACTED}")


# --- rendering -----------------------------------------------------------------


def _one_decimal(value: Column) -> Column:
    """One decimal of the number as stored; only exact quarters lie halfway, and they round up."""
    halfway = (value * 4 == F.floor(value * 4)) & (value * 2 != F.floor(value * 2))
    shown = F.when(halfway, F.ceil(value * 10) / 10).otherwise(value)
    return F.call_function("format_number", shown, F.lit("0.0"))


def format_bytes(size: Column | str) -> Column:
    size = _col(size).cast("double")
    kb, mb = size / 1024, size / 1048576
    whole = lambda value: F.round(value, 0).cast("bigint").cast("string")
    scaled = lambda value: F.when(value < 10, _one_decimal(value)).otherwise(whole(value))
    return (
        F.when(size.isNull() | F.isnan(size) | (size <= 0) | (size == float("inf")), F.lit("0 B"))
        .when(size < 1024, F.concat(whole(size), F.lit(" B")))
        .when(kb < 1024, F.concat(scaled(kb), F.lit(" KB")))
        .otherwise(F.concat(scaled(mb), F.lit(" MB")))
    )


def format_duration(millis: Column | str) -> Column:
    millis = _col(millis)
    seconds = millis / 1000
    return (
        F.when(millis < 1000, F.concat(F.round(millis, 0).cast("bigint").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(_one_decimal(seconds.cast("double")), F.lit("s")))
        .otherwise(
            F.concat(
                F.floor(seconds / 60).cast("string"),
                F.lit("m "),
                F.round(seconds - F.floor(seconds / 60) * 60, 0).cast("bigint").cast("string"),
                F.lit("s"),
            )
        )
    )


def truncate_text(text: Column | str, limit: int) -> Column:
    text = _col(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


@reused
def describe_statuses(statuses: Column | str) -> Column:
    statuses = _col(statuses)
    listed = F.array_join(F.transform(statuses, lambda s: s.cast("string")), ", ")
    return F.when(F.size(statuses) > 0, listed).otherwise(F.lit("no response"))


def show_value(value: Column | str) -> Column:
    """Quoted enum member."""
    return F.concat(F.lit('"'), _col(value), F.lit('"'))


def mermaid_label(label: Column | str) -> Column:
    escaped = F.replace(_col(label), F.lit('"'), F.lit("#quot;"))
    return F.replace(F.replace(escaped, F.lit("<"), F.lit("#lt;")), F.lit(">"), F.lit("#gt;"))


def table_cell(text: Column | str) -> Column:
    """Text safe inside a Markdown table cell."""
    piped = F.replace(_col(text), F.lit("|"), F.lit("\\|"))
    flat = F.regexp_replace(piped, r"[\r\n]+", " ")
    return F.replace(F.replace(flat, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def epoch_millis_text(millis: Column | str) -> Column:
    """ISO-8601 text of an epoch-millisecond stamp."""
    return F.date_format(F.timestamp_millis(_col(millis)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
