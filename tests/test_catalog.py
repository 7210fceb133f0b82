import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glintscan.functions.catalog import EFFECTIVE, RULES
from glintscan.operators import detect
from glintscan.plans import planted


def line_frame(spark, texts):
    return spark.createDataFrame([(1, 0, "p", i, t) for i, t in enumerate(texts, 1)], "page_id long, blob_ord int, path string, line int, text string")


def hits(spark, text):
    return {(RULES[r.det_ord - 1].name, r.token) for r in detect.matches(line_frame(spark, [text])).collect()}


def test_catalog():
    assert len(RULES) == 45 and len(EFFECTIVE) == 42
    assert [r.ord for r in RULES if not r.effective] == [9, 15, 17]


KEY = "abcdefghij0123456789_-Ab"


@pytest.mark.parametrize(("name", "text", "token"), [
    ("Generic API Key", f'api_key: "{KEY}"', KEY),
    ("Generic API Key", f'"api_key": "{KEY}"', None),
    ("Generic API Key", f"API-KEY = \"{KEY}'", KEY),
    ("Google API Key", "AI" + "za" + "a" * 34 + "-", None),
    ("Google API Key", "AI" + "za" + "a" * 34 + "_", "AI" + "za" + "a" * 34 + "_"),
    ("Google API Key", "AI" + "za" + "a" * 34 + "^", "AI" + "za" + "a" * 34 + "^"),
    ("Relative URL", '"/one"', None),
    ("Relative URL", '"/one/two/"', None),
    ("Relative URL", '"/one/two?x=1"', None),
    ("Relative URL", "'/one/two.js\"", "/one/two.js"),
    ("GraphQL Endpoint", '"/GraphQL"', None),
    ("GraphQL Endpoint", '"/v1/graphql/x"', "/v1/graphql/x"),
    ("SSH Private Key", "-----BEGIN " + "PRIVATE KEY-----", None),
    ("Password in URL", "ftp://user:pass@h/p", None),
    ("Password in URL", 'ftp://user:pass@h/p" x "', 'ftp://user:pass@h/p" x "'),
    ("Generic Password", "password: 'abcdefgh'", "abcdefgh"),
    ("Generic Password", "password: 'abcdefg'", None),
])
def test_rule(spark, name, text, token):
    assert {t for n, t in hits(spark, text) if n == name} == ({token} if token else set())


def test_overlapping_rules_both_fire(spark):
    key = "sk_" + "live_" + "0123456789abcdef" * 2
    assert {n for n, _ in hits(spark, key)} == {"Stripe API Key", "Picatic API Key"}


def test_long_path_does_not_recurse(spark):
    found = detect.matches(line_frame(spark, ['"' + "/a" * 100_000 + '"'])).collect()
    assert [len(r.token) for r in found] == [200_000]


def test_guards_and_dialect_agree_with_re2(spark):
    """Hostile characters between planted tokens: the same matches as plain patterns in RE2."""
    rng = random.Random(11)
    con = duckdb.connect()
    con.sql("CREATE TABLE pages AS SELECT 1 AS page_id, '' AS url, '' AS html")
    bodies = [b for (b,) in con.sql(f"SELECT body FROM ({planted.corpus('(SELECT unnest(range(1, 46)) AS k)')})").fetchall()]
    tokens = [b.split("\n")[1][10:-7] for b in bodies]
    glue = ["", " ", "\r", "\x0b", "\x85", " ", "\xa0", "ſ", "K", "'", '"', "<", "-", "_"]
    texts = []
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(tokens)
            parts += [rng.choice(glue), t.replace("s", "ſ") if rng.random() < 0.1 else t.upper() if rng.random() < 0.1 else t, rng.choice(glue)]
        texts.append("".join(parts))
    got = sorted((r.line, r.det_ord, r.match_ord, r.token) for r in detect.matches(line_frame(spark, texts)).collect())
    con.execute("CREATE TABLE l AS SELECT unnest(range(1, len(t) + 1)) AS line, unnest(t) AS text FROM (SELECT ? AS t)", [texts])
    want = []
    for r in EFFECTIVE:
        want += [(line, r.ord, k, t) for line, ts in con.execute("SELECT line, regexp_extract_all(text, ?, 1) FROM l", [r.pattern]).fetchall() for k, t in enumerate(ts)]
    assert len(want) > 500
    assert got == sorted(want)


def test_tokens_are_in_their_lines(spark):
    found = detect.matches(line_frame(spark, [f'api_key: "{KEY}" https://h.example/x']))
    assert found.filter(~F.contains("text", F.col("token"))).count() == 0
