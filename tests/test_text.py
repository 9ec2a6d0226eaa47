import pytest
from pyspark.sql import functions as F

from spendlens.functions import text as tx

NBSP = "\u00a0"

# FIXTURES §3.1: (title, short, long, expected)
CASES = [
    ("Housing project", "housing PROJECT", "A Housing Project in X", "A Housing Project in X"),
    ("T", None, None, "T"),
    ("Roof repair", "Roof", None, "Roof repair Roof"),
    ("Roof", "Roof repair", None, "Roof repair"),
    ("supply dam", "Water supply", "Dam", "Water supply Dam"),
    (None, None, None, ""),
    (None, "  ", None, ""),
    (None, None, NBSP + "Shelter" + NBSP, "Shelter"),
    ("Shelter ", None, "shelter", "Shelter  shelter"),
]


def test_activity_text_hand_cases(spark):
    df = spark.createDataFrame(CASES, "title string, short string, long string, expected string")
    got = df.select(tx.activity_text("title", "short", "long").alias("t"), "expected").collect()
    for r in got:
        assert r.t == r.expected


def python_reference(title, short, long):
    """Plain-Python statement of the rule, for property checks."""
    title, short, long = title or "", short or "", long or ""
    t = long
    if short and short.lower() not in t.lower():
        t = f"{short} {t}"
    if title and title.lower() not in t.lower():
        t = f"{title} {t}"
    return t.strip()


def test_activity_text_matches_python_rule_on_random_parts(spark):
    import random

    rnd = random.Random(7)
    words = ["Roof", "roof", "Repair", "water", "DAM", " ", "\u3000", "x", "", "\u00a0"]
    rows = []
    for _ in range(300):
        parts = [None if rnd.random() < 0.2 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))) for _ in range(3)]
        rows.append(tuple(parts))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [r.t for r in df.select(tx.activity_text("a", "b", "c").alias("t")).collect()]
    assert got == [python_reference(*r) for r in rows]


@pytest.mark.parametrize(
    "raw",
    ["  x  ", "  x\u3000", "\n\tx\r\n", "\x1c\x1d x \x1e\x1f", "x", "", "   ", "a b", "\u200bx\u200b", "\x85x ", "\u2003x\u00a0"],
)
def test_ustrip_equals_python_strip(spark, raw):
    got = spark.createDataFrame([(raw,)], "s string").select(tx.ustrip("s").alias("s")).first().s
    assert got == raw.strip()


def test_is_blank(spark):
    df = spark.createDataFrame([(" ",), ("　",), (None,), ("a",)], "s string")
    assert [r.b for r in df.select(tx.is_blank("s").alias("b")).collect()] == [True, True, True, False]


def test_contains_ci_and_empty_needle(spark):
    df = spark.createDataFrame([("Housing Project", "PROJECT"), ("abc", "")], "h string, n string")
    assert [r.c for r in df.select(tx.contains_ci("h", "n").alias("c")).collect()] == [True, True]


def test_user_message_and_payload(spark):
    df = spark.createDataFrame([("Build homes", "Low-cost housing"), ("Text", None)], "t string, s string")
    rows = df.select(tx.user_message("t", "s").alias("m")).collect()
    assert rows[0].m == "Build homes\nSector: Low-cost housing"
    assert rows[1].m == "Text\nSector: "
    import json

    p = df.select(tx.request_payload("SYS", tx.user_message("t", "s")).alias("p")).first().p
    assert json.loads(p) == [{"role": "system", "content": "SYS"}, {"role": "user", "content": "Build homes\nSector: Low-cost housing"}]


def test_token_count_and_cost(spark):
    df = spark.createDataFrame([("Hello, world! 123 abc",), (None,)], "t string")
    assert [r.n for r in df.select(tx.token_count("t").alias("n")).collect()] == [6, 0]
    c = spark.range(1).select(tx.cost(F.lit(1_000_000)).alias("c")).first().c
    assert c == pytest.approx(0.025 + 0.20)


def test_text_key_is_sha256_hex(spark):
    import hashlib

    k = spark.createDataFrame([("abc",)], "t string").select(tx.text_key("t").alias("k")).first().k
    assert k == hashlib.sha256(b"abc").hexdigest()


def test_activity_text_rich_alphabet(spark):
    import random

    rnd = random.Random(11)
    alphabet = ["a", "A", "é", "É", "İ", "i", "ß", "SS", "Σ", "σ", "ς", "日", " ", "\t", "\n", " ", "　", " ", "\x1f", ".", "Roof", "ROOF"]
    rows = []
    for _ in range(2000):
        parts = []
        for _ in range(3):
            if rnd.random() < 0.15:
                parts.append(None)
            else:
                parts.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))))
        rows.append(tuple(parts))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [r.t for r in df.select(tx.activity_text("a", "b", "c").alias("t")).collect()]
    want = [python_reference(*r) for r in rows]
    mismatches = [(r, g, w) for r, g, w in zip(rows, got, want) if g != w]
    assert not mismatches, mismatches[:3]
