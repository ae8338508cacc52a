"""Personal data and key material in text: detect, validate, redact, mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .core import as_col, hinted, let, matches, non_null, rewrite_matches


def luhn_ok(number: Column | str) -> Column:
    """Checksum over the digits of a text with 13 to 19 of them."""

    def checked(digits: Column) -> Column:
        def weight(d: Column, i: Column) -> Column:
            v = d.cast("int")
            return F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

        total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight),
                            F.lit(0), lambda a, x: a + x)
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(as_col(number), r"[^0-9]", ""), checked)


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""

    # equal characters stand together once sorted, so runs are the counts
    def bits(t: Column) -> Column:
        size = F.length(t).cast("double")
        sorted_text = F.array_join(F.sort_array(F.split(t, "")), "")
        runs = matches(sorted_text, r"(?s)(.)\1*")
        share = F.transform(runs, lambda r: F.length(r) / size)
        return F.when(t == "", F.lit(0.0)).otherwise(
            F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))

    return let(as_col(text), bits)


def has_uuid(text: Column | str) -> Column:
    return as_col(text).rlike(rules.UUID)


def key_ok(key: Column | str, min_entropy: float = rules.MIN_KEY_ENTROPY) -> Column:
    """Entropy gate.  The sum is rounded so that its order cannot matter."""
    return F.round(entropy(key), 9) >= F.lit(min_entropy)


def card_ok(number: Column | str, *, checksums: bool = True) -> Column:
    number = as_col(number)
    return ~has_uuid(number) & (luhn_ok(number) if checksums else F.lit(True))


def _found(kind: str, pattern: str, text: Column, checksums: bool) -> Column:
    if kind == "credit_card":
        hit = F.exists(matches(text, pattern), lambda m: card_ok(m, checksums=checksums))
    elif kind == "api_key_generic":
        hit = F.exists(matches(text, pattern, 1), lambda key: key_ok(key))
    else:
        return text.rlike(pattern)
    return text.rlike(pattern) & hit


def pii_types(text: Column | str, table: Sequence[tuple] = rules.PII_RULES, *,
              checksums: bool = True) -> Column:
    """Names of the rules that hit, in table order.

    The hint of a rule is tested before its pattern and spares most texts it.
    """

    def types(t: Column) -> Column:
        flags = []
        for kind, pattern, hint in table:
            hit = hinted(t, pattern, hint) & _found(kind, pattern, t, checksums)
            flags.append(F.when(hit, F.lit(kind)))
        return non_null(*flags)

    return let(as_col(text), types)


def _redact_step(kind: str, pattern: str, hint: str | tuple, checksums: bool):
    label = f"[REDACTED:{kind.upper()}]"

    def step(t: Column) -> Column:
        if kind == "credit_card":
            # the rewrite runs only where the pattern hits at all
            changed = F.when(t.rlike(pattern), rewrite_matches(
                t, pattern,
                lambda m, _: F.when(card_ok(m, checksums=checksums), F.lit(label)).otherwise(m),
            )).otherwise(t)
        elif kind == "api_key_generic":
            changed = F.when(t.rlike(pattern), rewrite_matches(
                t, pattern,
                lambda m, key: F.when(key_ok(key),
                                      F.replace(m, key, F.lit("[REDACTED:API_KEY]")))
                .otherwise(m),
                group=1,
            )).otherwise(t)
        else:
            changed = F.regexp_replace(t, pattern, label)
        return F.when(hinted(t, pattern, hint), changed).otherwise(t)

    return step


def redact(text: Column | str, table: Sequence[tuple] = rules.PII_RULES, *,
           enabled: bool = True, checksums: bool = True) -> Column:
    """Apply the rules one after the other, each to the result before it."""
    text = as_col(text)
    if not enabled:
        return text
    for kind, pattern, hint in table:
        text = let(text, _redact_step(kind, pattern, hint, checksums))
    return text


def mask(value: Column | str, redacted: Column | None = None) -> Column:
    """First and last four characters kept if longer than 12, else all stars."""
    v = as_col(value)
    size = F.length(v)
    stars = F.when(
        size > 12,
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), size - 8), F.substring(v, -4, 4)),
    ).otherwise(F.repeat(F.lit("*"), size))
    return stars if redacted is None else F.when(redacted, v).otherwise(stars)


def short_mask(value: Column | str) -> Column:
    v = as_col(value)
    return F.concat(F.left(v, F.lit(4)), F.lit("..."), F.right(v, F.lit(4)))
