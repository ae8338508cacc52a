import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from apiscope.functions import pii


def col(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


@pytest.mark.parametrize("number,ok", [
    ("4111111111111111", True), ("5555555555554444", True), ("378282246310005", True),
    ("1234567890123456", False), ("4111 1111 1111 1111", True), ("4111-1111-1111-1111", True),
    ("411111111111", False), ("41111111111111111111", False), ("", False)])
def test_luhn(spark, number, ok):
    assert col(spark, number, pii.luhn_ok) is ok


def test_entropy(spark):
    assert col(spark, "aaaaaaaaaa", pii.entropy) == 0.0
    assert col(spark, "", pii.entropy) == 0.0
    assert col(spark, "aB3$xY9!mK2#pQ8&", pii.entropy) > 3.5
    assert 2.5 < col(spark, "550e8400-e29b-41d4-a716-446655440000", pii.entropy) < 4.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n.*+é漢$\\1 ", max_size=40), min_size=1, max_size=8))
def test_entropy_by_brute_force(spark, texts):
    def brute(t):
        return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
        "x", pii.entropy("x").alias("y")).collect()
    assert all(math.isclose(r.y, brute(r.x), abs_tol=1e-9) for r in rows)


@pytest.mark.parametrize("text,types,redacted", [
    ("My card is 4111111111111111", ["credit_card"], "My card is [REDACTED:CREDIT_CARD]"),
    # the phone rule looks for word boundaries, so a long number is left alone
    ("Random number: 1234567890123456", [], "Random number: 1234567890123456"),
    ("ID: 550e8400-e29b-41d4-a716-446655440000", [], "ID: 550e8400-e29b-41d4-a716-446655440000"),
    ("api_key = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", [], "api_key = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("API-KEY: 'aB3xY9mK2pQ8zzTT7712ab8sdf7asd8f'", ["api_key_generic"],
     "API-KEY: '[REDACTED:API_KEY]'"),
    ("mail a.b@c.org, ip 10.0.0.1, ssn 123-45-6789", ["email", "ssn", "ipv4"],
     "mail [REDACTED:EMAIL], ip [REDACTED:IPV4], ssn [REDACTED:SSN]"),
    ("k AKIA" + "A1" * 8, ["api_key_aws"], "k [REDACTED:API_KEY_AWS]"),
    ("-----BEGIN RSA PRIVATE KEY-----", ["private_key"], "[REDACTED:PRIVATE_KEY]"),
])
def test_detect_and_redact(spark, text, types, redacted):
    assert col(spark, text, pii.pii_types) == types
    assert col(spark, text, pii.redact) == redacted


def test_only_the_matched_span_changes(spark):
    # the passing card also stands inside a longer run that is no match
    text = "x41111111111111110 and 4111111111111111"
    assert col(spark, text, pii.redact) == "x41111111111111110 and [REDACTED:CREDIT_CARD]"


@pytest.mark.parametrize("table,text,want", [
    ((("api_key_stripe", r"safe_stripe_[a-z0-9]+", ("safe",)),), "K=safe_stripe_12345",
     "K=[REDACTED:API_KEY_STRIPE]"),
    ((("api_key_aws", r"SAFE_AWS_[A-Z0-9]+", ("SAFE",)),), "K: SAFE_AWS_EXAMPLE",
     "K: [REDACTED:API_KEY_AWS]"),
])
def test_replaced_rule_tables(spark, table, text, want):
    assert col(spark, text, lambda c: pii.redact(c, table)) == want


def test_switches_and_idempotence(spark):
    text = "card 1234567890123456 mail a@b.com"
    assert col(spark, text, lambda c: pii.redact(c, enabled=False)) == text
    once = col(spark, text, lambda c: pii.redact(c, checksums=False))
    assert once == "card [REDACTED:CREDIT_CARD] mail [REDACTED:EMAIL]"
    assert col(spark, once, lambda c: pii.redact(c, checksums=False)) == once


def test_masks(spark):
    assert col(spark, "sk_live_1234567890", pii.mask) == "sk_l**********7890"
    assert col(spark, "short", pii.mask) == "*****"
    assert col(spark, "sk_live_1234567890", pii.short_mask) == "sk_l...7890"
