"""URL scalars: split, classify, normalise, sign."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .core import any_of, as_col, empty_strings, first_case, let, matches, non_null

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#(.*)$"


def cleaned(url: Column | str) -> Column:
    """Leading blanks and any tab or line break removed, as URL parsers do."""
    return F.regexp_replace(F.translate(as_col(url), "\t\r\n", ""), r"^[\x00-\x20]+", "")


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(cleaned(url), _SCHEME, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(cleaned(url), _NETLOC, 1)


def path(url: Column | str) -> Column:
    """Path without ``;parameters`` of the last segment."""
    return F.regexp_replace(F.regexp_extract(cleaned(url), _PATH, 1), r";[^/]*$", "")


def query(url: Column | str) -> Column:
    return F.regexp_extract(cleaned(url), _QUERY, 1)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(cleaned(url), _FRAGMENT, 1)


def host(url: Column | str) -> Column:
    """Lower-cased network location, cut at the first colon."""
    return F.split_part(F.lower(netloc(url)), F.lit(":"), F.lit(1))


def host_rejection(parts: Column, *, allow_ip: bool = False, block_internal: bool = True) -> Column:
    """First failing check of ``struct<scheme, netloc, host>``; '' if valid."""
    netloc_, host_ = parts["netloc"], parts["host"]
    cases = [
        (parts["scheme"] == "", F.lit("Missing URL scheme (http/https required)")),
        (~parts["scheme"].isin(*rules.SCHEMES),
         F.concat(F.lit("Invalid scheme '"), parts["scheme"], F.lit("', must be http/https"))),
        (netloc_ == "", F.lit("Missing domain/netloc in URL")),
        (netloc_.contains("@"), F.lit("URL contains embedded credentials (user:pass@host)")),
    ]
    if not allow_ip:
        cases.append((host_.rlike(rules.IPV4),
                      F.lit("IP addresses are not allowed, use domain names")))
    cases.append((host_.isin(*rules.LOCAL_HOSTS), F.lit("Localhost targets are not allowed")))
    if block_internal:
        cases.append((host_.isin(*rules.BLOCKED_HOSTS),
                      F.concat(F.lit("SSRF protection: Blocked hostname '"), host_, F.lit("'"))))
        if not allow_ip:
            cases.append((host_.rlike(any_of(rules.BLOCKED_RANGES)),
                          F.lit("SSRF protection: Internal/private IP range blocked")))
    return first_case(cases).otherwise(F.lit(""))


def validate(url: Column | str, *, allow_ip: bool = False, block_internal: bool = True) -> Column:
    """struct<ok, domain, reason>; the reason is the first check that fails."""
    url = as_col(url)

    def verdict(p: Column) -> Column:
        reason = host_rejection(p, allow_ip=allow_ip, block_internal=block_internal)
        broken = (p["netloc"].contains("[") != p["netloc"].contains("]"))
        early = (p["scheme"] == "") | ~p["scheme"].isin(*rules.SCHEMES) | (p["netloc"] == "")
        return F.struct(
            F.when(broken, F.lit("URL parsing failed: Invalid IPv6 URL"))
            .otherwise(reason).alias("reason"),
            F.when(broken | early, F.lit("")).otherwise(p["host"]).alias("domain"),
        )

    parts = F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"),
                     host(url).alias("host"))
    missing = F.struct(F.lit("Empty URL").alias("reason"), F.lit("").alias("domain"))
    checked = F.when(url.isNull() | (url == ""), missing).otherwise(let(parts, verdict))
    return let(checked, lambda c: F.struct((c["reason"] == "").alias("ok"),
                                           c["domain"].alias("domain"),
                                           c["reason"].alias("reason")))


def glob_regex(glob: str) -> str:
    """Anchored regex of a shell glob: ``*`` crosses dots, ``?``, ``[seq]``, ``[!seq]``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            close = glob.find("]", i + 1 if glob[i:i + 1] != "!" else i + 2)
            if close < 0:
                out.append(r"\[")
            else:
                body = glob[i:close].replace("\\", "\\\\").replace("[", r"\[")
                out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
                i = close + 1
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + "$"


def scope_pattern(pattern: str) -> str:
    """Scheme and trailing slashes removed, lower-cased."""
    return re.sub(r"^https?://", "", pattern).rstrip("/").lower()


def scope_reason(domain: Column, allowed: list[str], blocked: list[str]) -> Column:
    """'' if the domain is in scope, else why not.  Deny wins over allow."""
    cases = [(domain.rlike(glob_regex(p)), F.lit(f"Matched blocked pattern: {p}"))
             for p in map(scope_pattern, blocked)]
    allow = [glob_regex(scope_pattern(p)) for p in allowed]
    outside = (~domain.rlike(any_of(allow))) if allow else F.lit(False)
    cases.append((outside, F.lit("Not in allowed domains list")))
    return first_case(cases).otherwise(F.lit(""))


def with_scheme(target: Column | str) -> Column:
    """Trimmed target, ``https://`` in front unless it has an http(s) scheme."""
    t = F.regexp_replace(as_col(target), r"^\s+|\s+$", "")
    return F.when(t.startswith("http://") | t.startswith("https://"), t) \
        .otherwise(F.concat(F.lit("https://"), t))


def _fold_dots(segments: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        shorter = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", shorter).when(s == ".", acc).otherwise(
            F.concat(acc, F.array(s)))

    def done(segs: Column) -> Column:
        folded = F.aggregate(segs, empty_strings(), step)
        ends_in_dots = F.element_at(segs, -1).isin(".", "..")
        joined = F.array_join(
            F.when(ends_in_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return let(segments, done)


def _raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def resolve(base: Column | str, ref: Column | str) -> Column:
    """Absolute URL of ``ref`` seen from ``base`` (relative-reference rules)."""

    def joined(p: Column) -> Column:
        b, r = p["b"], p["r"]
        b_segs = F.split(_raw_path(b), "/", -1)
        kept = F.when(F.element_at(b_segs, -1) != "",
                      F.slice(b_segs, 1, F.size(b_segs) - 1)).otherwise(b_segs)
        r_path = _raw_path(r)
        r_segs = F.split(r_path, "/", -1)
        relative = F.concat(kept, r_segs)
        inner = F.concat(
            F.slice(relative, 1, 1),
            F.filter(F.slice(relative, 2, F.greatest(F.size(relative) - 2, F.lit(0))),
                     lambda s: s != ""),
            F.slice(relative, -1, 1),
        )
        folded = _fold_dots(F.when(r_path.startswith("/"), r_segs).otherwise(inner))
        rooted = F.when(folded.startswith("/"), folded).otherwise(F.concat(F.lit("/"), folded))
        r_query, r_frag = F.regexp_extract(r, _QUERY, 1), F.regexp_extract(r, _FRAGMENT, 1)
        origin = F.concat(F.lower(F.regexp_extract(b, _SCHEME, 1)), F.lit("://"),
                          F.regexp_extract(b, _NETLOC, 1))

        def tail(q: Column) -> Column:
            return F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                            F.when(r_frag != "", F.concat(F.lit("#"), r_frag))
                            .otherwise(F.lit("")))

        same_page = F.concat(
            origin, _raw_path(b),
            tail(F.when(r_query != "", r_query).otherwise(F.regexp_extract(b, _QUERY, 1))))
        r_scheme = F.lower(F.regexp_extract(r, _SCHEME, 1))
        return (
            F.when(r == "", b)
            .when(r_scheme != "", r)
            .when(r.startswith("//"),
                  F.concat(F.lower(F.regexp_extract(b, _SCHEME, 1)), F.lit(":"), r))
            .when(r_path == "", same_page)
            .otherwise(F.concat(origin, rooted, tail(r_query)))
        )

    return let(F.struct(cleaned(base).alias("b"), cleaned(ref).alias("r")), joined)


def storage_key(url: Column | str) -> Column:
    """``host/path``; a query becomes eight md5 digits before the extension."""

    def key(p: Column) -> Column:
        stem = F.when(p["path"] == "", F.lit("index.js")).otherwise(p["path"])
        mark = F.concat(F.lit("_"), F.substring(F.md5(p["query"]), 1, 8))
        # the digest is hex, so it is safe inside a replacement text
        hashed = F.when(stem.contains("."),
                        F.concat(F.regexp_extract(stem, r"(?s)^(.*)\.[^.]*$", 1), mark, F.lit("."),
                                 F.substring_index(stem, ".", -1))).otherwise(F.concat(stem, mark))
        return F.concat(p["host"], F.lit("/"),
                        F.when(p["query"] == "", stem).otherwise(hashed))

    return let(F.struct(F.translate(netloc(url), ":", "_").alias("host"),
                        F.regexp_replace(path(url), r"^/+|/+$", "").alias("path"),
                        query(url).alias("query")), key)


def endpoint_key(method: Column | str, url: Column | str) -> Column:
    return F.concat(as_col(method), F.lit(":"), netloc(url), path(url))


def is_api_url(url: Column | str) -> Column:
    url = as_col(url)
    return F.coalesce(
        (url != "")
        & url.rlike("(?i)" + any_of((rules.API_ANY_HOST, rules.API_NO_HOST)))
        & ~url.rlike("(?i)" + any_of(rules.NOT_API)),
        F.lit(False),
    )


def strip_origin(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), r"^https?://[^/]+", "")


def signature(method: Column | str, url: Column | str, *, strip_host: bool = False) -> Column:
    """``METHOD:url`` with ``{x}`` as ``{param}`` and ``:x`` as ``:param``."""
    target = strip_origin(url) if strip_host else as_col(url)
    braces = F.regexp_replace(target, r"\{[^}]+\}", "{param}")
    return F.concat(as_col(method), F.lit(":"),
                    F.regexp_replace(braces, r":[a-zA-Z_]+", ":param"))


def match_signature(method: Column | str, url: Column | str, *, strip_host: bool = False) -> Column:
    """Signature for comparison with a spec: one parameter style, no end slash."""
    target = strip_origin(url) if strip_host else as_col(url)
    for style in (r"\{[^}]+\}", r":[a-zA-Z_]+", r"<[^>]+>"):
        target = F.regexp_replace(target, style, "{param}")
    return F.concat(as_col(method), F.lit(":"), F.regexp_replace(target, r"/+$", ""))


def spec_signature(method: Column | str, path_: Column | str) -> Column:
    return F.concat(as_col(method), F.lit(":"),
                    F.regexp_replace(as_col(path_), r"\{[^}]+\}", "{param}"))


def openapi_path(url: Column | str) -> Column:
    """Path in OpenAPI form: no origin, no query, ``:x`` as ``{x}``."""
    bare = F.split_part(strip_origin(url), F.lit("?"), F.lit(1))
    rooted = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.regexp_replace(rooted, r":([a-zA-Z_][a-zA-Z0-9_]*)", r"{$1}")


def path_params(url: Column | str) -> Column:
    """Names in ``{x}``, ``:x`` and ``<x>``, in order."""
    found = matches(as_col(url), r"\{[^}]+\}|:[a-zA-Z_]+|<[^>]+>")
    return F.transform(found, lambda m: F.regexp_replace(m, r"^[{:<]|[}>]$", ""))


def tags(url: Column | str) -> Column:
    """Resource tags by pattern, then the version, else one default tag."""
    url = as_col(url)
    version = F.regexp_extract(url, r"/v(\d+)/", 1)
    found = non_null(
        *[F.when(url.rlike("(?i)" + p), F.lit(tag)) for p, tag in rules.TAG_PATTERNS],
        F.when(version != "", F.concat(F.lit("v"), version)),
    )
    return let(found, lambda t: F.when(F.size(t) > 0, t)
               .otherwise(F.array(F.lit(rules.DEFAULT_TAG))))


def schema_name(url: Column | str) -> Column:
    """PascalCase name of the last segment that is no version and no parameter."""
    parts = F.split(F.regexp_replace(as_col(url), r"^/+|/+$", ""), "/", -1)
    named = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^v\d+$|^[{:<]"))
    words = F.split(F.try_element_at(named, F.lit(-1)), "[-_]", -1)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                              F.lower(F.substr(w, F.lit(2))))), "")


def is_graphql_like(url: Column | str) -> Column:
    return F.lower(as_col(url)).rlike("|".join(rules.GRAPHQL_WORDS))


def query_params(url: Column | str) -> Column:
    """array<struct<name, value>> of the query string."""
    pairs = F.filter(F.split(query(url), "&", -1), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(
        F.split_part(p, F.lit("="), F.lit(1)).alias("name"),
        F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("value")))


def archive_url(timestamp: Column | str, original: Column | str) -> Column:
    return F.concat(F.lit(rules.ARCHIVE_PREFIX), as_col(timestamp), F.lit("id_/"),
                    as_col(original))


def archive_file(timestamp: Column | str, original: Column | str) -> Column:
    """``timestamp_name`` of a capture; ``index.js`` where the path has no name."""
    name = F.substring_index(F.regexp_replace(path(original), r"/+$", ""), "/", -1)
    return F.concat(as_col(timestamp), F.lit("_"),
                    F.when(name.isin("", "."), F.lit("index.js")).otherwise(name))


def capture_time(timestamp: Column | str) -> Column:
    """``yyyyMMddHHmmss`` read as UTC; NULL where malformed."""
    return F.try_to_timestamp(F.concat(as_col(timestamp), F.lit("+0000")),
                              F.lit("yyyyMMddHHmmssxx"))


def snippet(text: Column | str, size: int = rules.CONTEXT_CHARS) -> Column:
    """Short display context of a longer text."""
    return F.substring(as_col(text), 1, size)
