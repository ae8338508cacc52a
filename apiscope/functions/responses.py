"""Verdicts about recorded HTTP responses.

``headers`` is a ``map<string,string>`` with lower-cased keys (see
``sources.feeds.response_log``).  Bodies are read whole; pass ``body_chars`` to
look at a prefix only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .core import as_col, contains_all, first_case, let, non_null


def header(headers: Column | str, name: str) -> Column:
    return F.coalesce(F.try_element_at(as_col(headers), F.lit(name)), F.lit(""))


def _body(body: Column | str, body_chars: int | None) -> Column:
    text = F.coalesce(as_col(body), F.lit(""))
    return text if body_chars is None else F.substring(text, 1, body_chars)


def _any_rule(body: Column, table: Sequence[tuple]) -> Column:
    """One of the patterns occurs; its words are looked for first."""
    def test(b: Column) -> Column:
        hits = [contains_all(b["low"], words) & b["text"].rlike("(?i)" + pattern)
                for pattern, words in table]
        return reduce(lambda x, y: x | y, hits)

    return let(F.struct(body.alias("text"), F.lower(body).alias("low")), test)


def has_stack_trace(body: Column | str, body_chars: int | None = None) -> Column:
    return _any_rule(_body(body, body_chars), rules.STACK_TRACES)


def has_sensitive_error(body: Column | str, body_chars: int | None = None) -> Column:
    return _any_rule(_body(body, body_chars), rules.SENSITIVE_ERRORS)


def has_open_cors(headers: Column | str) -> Column:
    return header(headers, "access-control-allow-origin") == "*"


def is_json(headers: Column | str) -> Column:
    return F.lower(header(headers, "content-type")).contains("application/json")


def is_legacy_xml(headers: Column | str) -> Column:
    return F.lower(header(headers, "content-type")).contains("text/xml") & ~is_json(headers)


def status_category(status: Column | str) -> Column:
    status = as_col(status)
    cases = [(status == code, F.lit(cat)) for code, cat, _ in rules.STATUS_CATEGORIES]
    cases.append((status >= 500, F.lit("error")))
    return first_case(cases).otherwise(F.lit("unknown"))


def status_note(status: Column | str) -> Column:
    status = as_col(status)
    cases = [(status == code, F.lit(note)) for code, _, note in rules.STATUS_CATEGORIES if note]
    cases.append((status >= 500, F.concat(F.lit("Server error ("), status.cast("string"),
                                          F.lit(")"))))
    return first_case(cases)


def classify(status: Column | str, headers: Column | str, body: Column | str,
             body_chars: int | None = None) -> Column:
    """struct: category, confidence, four flags and the notes in check order."""
    flags = F.struct(
        has_stack_trace(body, body_chars).alias("trace"),
        has_sensitive_error(body, body_chars).alias("leak"),
        has_open_cors(headers).alias("cors"),
        is_json(headers).alias("json"),
        is_legacy_xml(headers).alias("xml"),
    )
    return let(flags, lambda f: F.struct(
        F.when(f["trace"], F.lit("vulnerable")).otherwise(status_category(status))
        .alias("category"),
        F.lit(1.0).alias("confidence"),
        f["trace"].alias("has_stack_trace"),
        f["cors"].alias("has_cors_issue"),
        f["json"].alias("is_json_api"),
        f["xml"].alias("is_legacy"),
        non_null(
            status_note(status),
            F.when(f["trace"], F.lit("Exposes stack trace")),
            F.when(f["leak"], F.lit("Contains sensitive error message")),
            F.when(f["cors"], F.lit("Wildcard CORS - potential security issue")),
            F.when(f["xml"], F.lit("XML response in potentially JSON-first API")),
        ).alias("notes"),
    ))


def is_deprecated(headers: Column | str) -> Column:
    link = header(headers, "link")
    return (
        (header(headers, "deprecation") != "")
        | (header(headers, "sunset") != "")
        | link.contains('rel="sunset"')
        | link.contains('rel="deprecation"')
        | (header(headers, "x-deprecated") != "")
        | F.lower(header(headers, "warning")).contains("deprecated")
    )


def deprecation_word(body: Column | str, body_chars: int | None = None) -> Column:
    """First word of the list that occurs in the body, NULL if none does."""
    return let(F.lower(_body(body, body_chars)),
               lambda b: first_case((b.contains(w), F.lit(w)) for w in rules.DEPRECATION_WORDS))


def old_copyright_year(body: Column | str, as_of_year: int, min_age: int = 3) -> Column:
    """First copyright year of the body if it is ``min_age`` years old."""
    year = F.regexp_extract(_body(body, None), rules.COPYRIGHT, 1)
    return let(F.when(year != "", year.cast("int")),
               lambda y: F.when(F.lit(as_of_year) - y >= min_age, y))


def old_server(headers: Column | str) -> Column:
    server = header(headers, "server")
    return first_case((server.rlike(p), F.lit(name)) for p, name in rules.OLD_SERVERS)


def age_indicators(headers: Column | str, body: Column | str, as_of_year: int) -> Column:
    """Hints of an old interface, in check order."""
    warning = header(headers, "warning")
    return non_null(
        F.when(F.lower(warning).contains("deprecated"),
               F.concat(F.lit("Warning header: "), warning)),
        F.concat(F.lit("Body contains: '"), deprecation_word(body), F.lit("'")),
        F.concat(F.lit("Old copyright year: "),
                 old_copyright_year(body, as_of_year).cast("string")),
        F.concat(F.lit("Old server version: "), old_server(headers)),
    )


def http_date(value: Column | str) -> Column:
    """Date of four header formats as a timestamp; NULL for other texts.

    Every format is brought to one ISO form with an offset, so the result does
    not depend on the session time zone.
    """
    v = as_col(value)
    iso = (
        F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(v, F.lit("T00:00:00+00:00")))
        .when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$"),
              F.concat(F.rtrim(v, F.lit("Z")), F.lit("+00:00")))
        .when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{2}:?\d{2}$"),
              F.regexp_replace(v, r"([+-]\d{2}):?(\d{2})$", "$1:$2"))
    )
    rfc = F.when(v.rlike(r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} (GMT|UTC)$"),
                 F.regexp_replace(F.substr(v, F.lit(6)), r"(GMT|UTC)$", "+00:00"))
    return F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-M-d'T'H:m:sXXX")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy H:m:sXXX".replace("sXXX", "s XXX"))),
    )


def is_graphql_response(status: Column | str, body: Column | str) -> Column:
    keys = F.json_object_keys(F.when(as_col(status) == 200, as_col(body)))
    return F.coalesce(F.array_contains(keys, "data") | F.array_contains(keys, "errors"),
                      F.lit(False))


def size_change(baseline: Column, variant: Column) -> Column:
    """Relative size change; NULL for an empty baseline."""
    return F.try_divide(F.abs(variant - baseline).cast("double"), baseline.cast("double"))


def reflected_fields(status: Column | str, body: Column | str) -> Column:
    """Names of sensitive fields whose name and value both occur in the body."""

    def hits(b: Column) -> Column:
        return non_null(*[F.when(b.contains(f.lower()) & b.contains(v), F.lit(f))
                          for f, v in rules.SENSITIVE_FIELDS])

    return F.when(as_col(status) < 400, let(F.lower(F.coalesce(as_col(body), F.lit(""))), hits)) \
        .otherwise(F.array().cast("array<string>"))


def probed_status(status: Column, found: Column, code: Column, deprecated: Column) -> Column:
    """Endpoint status after a recorded response.

    ``found`` false means the request failed; a deprecation header overrides
    whatever the code says; other codes leave the status as it was.
    """
    return (
        F.when(~found, F.lit("dead"))
        .when(deprecated, F.lit("zombie"))
        .when(code < 400, F.lit("verified"))
        .when(code.isin(401, 403), F.lit("protected"))
        .otherwise(status)
    )
