import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.constants import PII_PATTERNS
from gaugeworks.functions import pii


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("text", ["call 555-123-4567", "call 555.123.4567", "call 5551234567"])
def test_phone_separators(spark, text):
    assert list(one(spark, text, pii.detect("t"))) == ["phone"]


def test_mixed_kinds(spark):
    text = "john@example.com or 555-123-4567, number 123-45-6789"
    assert one(spark, text, pii.kinds("t")) == ["email", "phone", "ssn"]
    assert not one(spark, text, pii.is_clean("t"))
    assert one(spark, text, pii.summary("t")) == "PII detected: 1 email, 1 phone, 1 ssn"


def test_lookalikes_are_clean(spark):
    assert one(spark, "not@an@email and 123456789", pii.is_clean("t"))
    assert one(spark, None, pii.is_clean("t")) and one(spark, "", pii.summary("t")) == "No PII detected"


def test_redaction_counts_and_order(spark):
    df = spark.createDataFrame([("Email a@b.com or c@d.org",), ("ring 555-123-4567 at 12 Main Street",), ("clean",), (None,)], "t string")
    rows = pii.redact(df, "t").collect()
    assert rows[0]["redacted_text"] == "Email [EMAIL] or [EMAIL]" and rows[0]["n_email"] == 2
    assert rows[1]["redacted_text"] == "ring [PHONE] at [ADDRESS]"
    assert rows[2]["redacted_text"] == "clean" and rows[3]["redacted_text"] is None
    totals = {r["kind"]: r["total"] for r in pii.redaction_totals(df, "t").collect()}
    assert totals == {"email": 2, "phone": 1, "ssn": 0, "address": 1}
    flagged = pii.flag(df, "t").collect()
    assert [r["has_pii"] for r in flagged] == [True, True, False, False]


def test_custom_pattern(spark):
    df = spark.createDataFrame([("STU123456 wrote",)], "t string")
    row = pii.redact(df, "t", {"student_id": r"\bSTU\d{6}\b"}).first()
    assert row["redacted_text"] == "[STUDENT_ID] wrote" and row["n_student_id"] == 1


PIECES = st.sampled_from(["a@b.com", "é@b.com", "555-123-4567", "123-45-6789", "12 Main Street", "9 rue Ave", "plain", "\n", "été", "4125551234", "x.y@z.co.uk", "٣٣٣-٤٤٤-٥٥٥٥"])


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=8).map(" ".join), min_size=20, max_size=40))
def test_matches_python_patterns(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in pii.redact(df, "t").collect()}
    found = {r["i"]: r["d"] for r in df.select("i", pii.detect("t").alias("d")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == {k: re.findall(p, text) for k, p in PII_PATTERNS.items() if re.findall(p, text)}
        for kind, pattern in PII_PATTERNS.items():
            assert got[i][f"n_{kind}"] == len(re.findall(pattern, text))
            text = re.sub(pattern, f"[{kind.upper()}]", text)
        assert got[i]["redacted_text"] == text
    again = pii.redact(spark.createDataFrame([(r["redacted_text"],) for r in got.values()], "t string"), "t")
    assert again.where(F.col("t") != F.col("redacted_text")).count() == 0


def test_patterns_of_the_caller_are_not_guessed(spark):
    df = spark.createDataFrame([("my passport is lost",), ("nr 123456789",), ("none",)], "t string")
    own = {"document": r"\b\d{9}\b|passport"}
    rows = pii.redact(df, "t", own).select("redacted_text", "n_document", pii.is_clean("t", own).alias("clean"), F.size(pii.detect("t", own)).alias("kinds")).collect()
    assert [tuple(r) for r in rows] == [("my [DOCUMENT] is lost", 1, False, 1), ("nr [DOCUMENT]", 1, False, 1), ("none", 0, True, 0)]
