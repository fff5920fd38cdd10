"""Topic catalogues of any length, and the literals of patterns."""

import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions.literals import fold, required_literals
from postloom.operators.catalogue import catalogue_literals, tag_topics


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("flu", ["flu"]),
        ("(?iu)Covid[-_ ]?19", ["covid 19", "covid-19", "covid19", "covid_19"]),
        ("corona(virus)?", ["corona", "coronavirus"]),
        (r"\bmask\w*|gloves?", ["glove", "gloves", "mask"]),
        ("(?:tion|ment|keit)+", ["keit", "ment", "tion"]),
        (r"a{2,3}b\d+xyz", ["xyz"]),
        (r"(?=look)ahead", ["ahead"]),
        ("x++yz", ["yz"]),
        (r"\x41Bc", ["abc"]),
        ("中文|word", ["word", "中文"]),
        ("[#@]{2}", ["##", "#@", "@#", "@@"]),
        (r"colou?r\.", ["color.", "colour."]),
        # none that every match holds, or forms that are not followed
        ("a*", []), ("a|", []), (r"\d+", []), ("[^a]", []), ("école", ["cole"]), ("é", []),
        (r"\Qab\E", []), ("(?x) a b", []), ("[a&&[b]]", []), (r"(a)\1", []), ("a{", []), ("(", []),
    ],
)
def test_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_no_match_without_a_literal(spark):
    """Random patterns and texts: where the JVM finds a match, the folded text has a literal."""
    draw = random.Random(4)
    letters = ["a", "b", "S", "k", "i", "é", "ß", ".", "\\.", "[ab]", "[^b]", "\\w", "(?:ab|K)", "(a|s)", "\\b", "ſ"]

    def pattern():
        parts = [draw.choice(letters) + draw.choice(["", "", "", "?", "+", "*", "{2}", "{1,3}+"]) for _ in range(draw.randint(1, 5))]
        if draw.random() < 0.3:
            parts.insert(draw.randint(0, len(parts)), "|")
        return draw.choice(["", "(?i)", "(?iu)"]) + "".join(parts)

    rows = [
        (pattern(), "".join(draw.choice("abSskKİıſ.éß x") for _ in range(draw.randint(0, 12))))
        for _ in range(6000)
    ]
    rows = [(p, t) for p, t in rows if "\\b{" not in p and "\\b+" not in p and "\\b*" not in p and "\\b?" not in p]
    hits = spark.createDataFrame(rows, "p string, t string").where(F.rlike("t", F.col("p"))).collect()
    assert len(hits) > 1000
    known = 0
    for r in hits:
        literals = required_literals(r["p"])
        known += bool(literals)
        assert not literals or any(x in fold(r["t"]) for x in literals), r
    assert known > 300


TEXTS = ["The FLU and covid-19, COVID19", "Straße masked?", "", None, "ſilver kİlo", "no hit", "aab", "x" * 5000 + "flu"]
PATTERNS = {
    "flu": "(?iu)flu", "covid": "(?iu)covid-?19", "any": ".*", "none": "zzz", "kilo": "(?iu)kilo",
    "silver": "(?iu)silver", "street": "stra[ßs]", "double": "(a)\\1b", "empty": "",
}


@pytest.mark.parametrize("block_chars", [1 << 22, 10])
def test_topics_as_rlike_finds_them(spark, block_chars):
    posts = spark.createDataFrame([(i, t, {"m": i}, "x") for i, t in enumerate(TEXTS)], "id int, text string, extra map<string,int>, pattern string")
    topics = spark.createDataFrame([*PATTERNS.items(), (None, "flu"), ("never", None)], "topic string, pattern string")
    tagged = tag_topics(posts, "text", topics, block_chars)
    assert tagged.columns == ["id", "text", "extra", "pattern", "topic"]
    expected = posts.select("id", "text").crossJoin(topics.where("topic is not null")).where("text rlike pattern")
    got = sorted((r["id"], r["topic"]) for r in tagged.collect())
    assert got == sorted((r["id"], r["topic"]) for r in expected.collect())
    assert "Join" not in plan_of(tagged) and "Cartesian" not in plan_of(tagged)


def test_topics_of_many_patterns(spark):
    """A hundred thousand patterns: one scan of the posts, and the same hits as word by word."""
    n = 100_000
    topics = spark.range(n).select(
        F.format_string("t%05d", "id").alias("topic"), F.format_string("(?iu)\\bW%05d\\b", "id").alias("pattern")
    )
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(2 * n):05}" for _ in range(200)) for _ in range(40)]
    posts = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tagged = tag_topics(posts, "text", topics)
    got = {(r["id"], r["topic"]) for r in tagged.select("id", "topic").collect()}
    expected = {(i, "t" + w) for i, t in enumerate(texts) for w in re.findall(r"\bw(\d{5})\b", t)}
    assert got == expected
    assert plan_of(tagged).count("Scan ExistingRDD") == 1
    assert tag_topics(posts, "text", topics, block_chars=400_000).count() == len(expected)


def test_topics_with_several_patterns_and_odd_tables(spark):
    posts = spark.createDataFrame([(1, "a b c"), (2, "c"), (2, "c"), (3, None)], "id int, t string")
    topics = spark.createDataFrame([("one", "a"), ("one", "(?i)C"), ("one", "c"), ("two", "b$|^c")], "topic string, pattern string")
    got = sorted((r["id"], r["topic"]) for r in tag_topics(posts, "t", topics).collect())
    assert got == [(1, "one"), (2, "one"), (2, "one"), (2, "two"), (2, "two")]
    assert tag_topics(posts, "t", topics.limit(0)).count() == 0
    assert tag_topics(posts.limit(0), "t", topics).count() == 0
    rows = catalogue_literals(topics).collect()
    assert {(r["topic"], r["pattern"]) for r in rows} == {("one", "(?:(?i)C)|(?:a)|(?:c)"), ("two", "b$|^c")}


def test_fixed_topics_have_literals():
    assert all(required_literals(p) for p in fixed.TOPICS.values() if p != "\n")
