"""Golden texts for the column functions."""

import time

import pytest
from pyspark.sql import functions as F

from postloom.functions import bag, markers, normalise, words
from postloom.functions.emoji import find_emoji
from postloom.registry.texts import EMOJI_SEQUENCES

POST = (
    "Morning round-up 🌻 by @desk_7: COVID 19 numbers fell again\n\nwhy does corona-virus news "
    "https://news.example/day/2?x=1 still trend with #covid_19, #CoronaVirus\n"
    "and sarscov2? pic.twitter.com/Zq8 or https://youtu.be/Lm4 both show it 🌻 \n"
)


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (markers.newlines_to_space, "a\n\nb\nc", "a b c"),
        (markers.unify_disease_name, "a corona  virus, one CoronaVirus; corona alone", "a corona  virus, one coronavirus; corona alone"),
        (lambda c: markers.unify_disease_name(c, True), "corona #corona", "coronavirus #coronavirus"),
        (markers.unify_disease_code, "x COVID 19 y covid_19 z Covid-19", "x covid19 y covid19 z covid19"),
        (lambda c: markers.unify_disease_code(c, True), "covid-19 covid", "covid19 covid"),
        (markers.mark_disease_name_tag, "see #coronavirus! but #coronavirusfacts", "see xxhash coronavirus! but #coronavirusfacts"),
        (markers.mark_disease_code_tag, "on #Covid19 and #covid-19 too", "on xxhash covid19 and xxhash covid19 too"),
        (markers.unify_virus_code, "the sars-cov-2 strain", "the sarscov2 strain"),
        (markers.mark_hashtags, "#a", "xxhash a"),
        (lambda c: markers.mark_hashtags(c, "whole"), "#a_b: #c d", "xxhashtag: xxhashtag d"),
        (markers.mark_mentions, "@a", "xxmention a"),
        (lambda c: markers.mark_mentions(c, "whole"), "hey @a_b: x", "hey xxuser: x"),
        (markers.mark_emoji_named, "a🧐b 10:30:45", "a xxemoji facewithmonocle b 10:30:45"),
        (markers.mark_emoji, "👍🏽👍 ok", " xxemoji  xxemoji  ok"),
        (find_emoji, "x 👍 y 🧐", ":thumbs_up_sign:,:face_with_monocle:"),
        (find_emoji, "10:30:45", None),
        (markers.mark_picture_links, "pic.twitter.com/aB1 x", " xxpictwit  x"),
        (markers.mark_video_links, "https://youtu.be/x?y z", " xxyoutubeurl  z"),
        (markers.mark_links, "see example.org now http://a.b/c?d www.x.yy, end", "see  xxurl  now  xxurl   xxurl , end"),
        (markers.mark_links, "end.The", " xxurl "),
        (lambda c: markers.mark_links(c, False), "end.The example.org", "end.The example.org"),
        (markers.space_punctuation, "(x) y", " ( x ) y"),
        (markers.space_punctuation, "a,b!c", "a , b ! c"),
        (markers.mark_punctuation, "wait...", "wait xxpunc xxpunc xxpunc "),
        (markers.mark_numbers, "12 apples a1 -3.5", "$NUMBER$ apples a1 $NUMBER$"),
        (markers.collapse_spaces, "a   b", "a b"),
        (normalise.repair_contractions, "can't go ain't so cannot go I'm they've x", "can't go ain't so can not go I 'm they 've x"),
        (normalise.repair_day_halves, "5 p . m . 6 a . m x", "5  p.m. 6 a.m x"),
        (normalise.rejoin_digits, "12 / 2020 10- 20 ,12 , 34", "12/2020 10-20 ,12,34"),
        (normalise.squeeze, " a  \t b\n", "a b"),
        (normalise.normalise_post, "@you see https://a.b/c, can’t wait… 🧐", "@user see httpurl , can't wait ... :face_with_monocle:"),
        (normalise.normalise_post, "I can't, they've 1/2020 at www.x.org", "i can't , they 've 1/2020 at httpurl"),
        (bag.ascii_only, "naïve café", "nave caf"),
        (bag.drop_joined_words, "a well-known it's - x", "a   - x"),
        (lambda c: bag.letters_only(c, ["then"]), "@me Then http://x.y/abcdef Words! of #Tagged", "http abcdef words tagged"),
        (lambda c: bag.normalise_words(c, ["the"]), "The covid-19covid-19, corona!", "covid19 coronavirus"),
        (lambda c: words.remove_stop_words(words.words(c), ["the"]), "the The a the a", "The a a"),
    ],
)
def test_golden(one, function, text, expected):
    assert one(function, text) == expected


def test_whole_post(one):
    assert one(markers.clean_markers, POST) == (
        "Morning round-up xxemoji sunflower by xxmention desk_7: covid19 numbers fell again why "
        "does corona-virus news xxurl still trend with xxhash covid19, xxhash coronavirus and "
        "sarscov2? xxpictwit or xxyoutubeurl both show it xxemoji sunflower"
    )


def test_whole_post_words(one):
    clean = one(lambda c: markers.clean_markers(c, True, stop_words=["by", "does"]), POST)
    assert clean.startswith("Morning roundup xxemoji sunflower xxmention desk7 covid19 numbers fell")
    assert " why coronavirus news " in clean


def test_first_form(one):
    clean = one(markers.clean_markers_first, POST)
    assert "xxuser" in clean and "xxhashtag" in clean and " xxemoji " in clean and "\n" not in clean


def test_bag(one):
    found = one(bag.bag_of_words, "🧐 Hi @you, #tag (see) http://a.b/c ! end.")
    assert found == ["Hi", "see", "end"]


def test_null_stays_null(one):
    for function in (markers.clean_markers, normalise.normalise_post, bag.letters_only):
        assert one(function, None) is None


def test_very_long_text(one):
    """Whole texts, however long, and without deep recursion."""
    text = "a.b-" * 20_000 + " covid-19 " + "." * 50_000 + "x" * 100_000 + "#<-" * 10_000 + "1-" * 20_000
    assert "covid19" in one(markers.clean_markers, text)
    assert one(lambda c: F.length(normalise.normalise_post(c)), text) > 200_000


def test_text_stays_in_the_jvm(spark, data):
    from conftest import plan_of

    rows = spark.read.parquet(f"{data}/documents.parquet")
    plan = plan_of(
        rows.select(markers.clean_markers(F.col("text"), True, True), normalise.normalise_post(F.col("text")))
    )
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_cleaning_is_deterministic_for_the_optimizer(spark, data):
    """A filter on another column still reaches the scan below a cleaning."""
    from conftest import plan_of

    rows = spark.read.parquet(f"{data}/documents.parquet")
    clean = rows.select("lang", markers.clean_markers(F.col("text")).alias("c")).where("lang = 'en'")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan_of(clean)


def test_long_runs_are_one_token(spark):
    """Runs of any length before a tag, or in an arrow, are not cut."""
    texts = ["#" * 12 + "tag a", "-" * 25 + "> b", "<" + "-" * 30 + " c", "---- d", "## e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", normalise.post_tokens(F.col("t")).alias("w")).collect()}
    assert got == {
        0: [texts[0][:-2], "a"],
        1: [texts[1][:-2], "b"],
        2: [texts[2][:-2], "c"],
        3: [*"----", "d"],
        4: [*"##", "e"],
    }


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", normalise.post_tokens(F.col("t")).alias("w")).collect()
    return [r["w"] for r in sorted(rows)]


def test_long_hosts_and_mailboxes_are_one_token(spark):
    """No length cuts a host, a mailbox or a domain."""
    host = "a-1." * 2500 + "org"
    box, domain = "b." * 5000 + "c", "d-d." * 2500 + "example"
    whole = [host, host + "/path?x=1", f"{box}@{domain}", "x" * 10_000 + ".com", "www." + "y" * 10_000]
    assert tokens(spark, [f"see {w} now" for w in whole]) == [["see", w, "now"] for w in whole]


def test_hosts_and_mailboxes_begin_with_their_run(spark):
    found = tokens(
        spark,
        ["...example.org", "see -example.org", "a.b.example.org.", "x@y", "a@b.c-", "l'amour.x.de", "-a@b.co", ":-D a", "1.2.3", "-5-3 .5"],
    )
    assert found == [
        ["...", "example.org"], ["see", "-", "example.org"], ["a.b.example.org", "."], ["x", "@y"], ["a@b.c", "-"],
        ["l'amour", ".", "x", ".", "de"], ["-a@b.co"], [":-D", "a"], ["1.2", ".", "3"], ["-5-3", ".", "5"],
    ]


@pytest.mark.parametrize(
    "unit",
    list("a1.-_@#<>:'/+,é中🧐=)\\ \n")
    + ["a.", "a-", "a..", "a@", "@a", "a'", ".-", "www.", "http://", "a@b.", "1-", "-1", "<a", "#a", "a_.", "=)", "a+", ". ", "a.com_", "a.b@"],
)
def test_a_megabyte_of_anything_is_linear(spark, unit):
    """A token list of 1 MB of one character, or of one short piece, in about a second."""
    text = unit * (1_000_000 // len(unit.encode()))
    df = spark.createDataFrame([(text,), (text + " x.org b@c.de",)], "t string").coalesce(1)
    start = time.perf_counter()
    kept = df.select(F.length(F.array_join(normalise.post_tokens(F.col("t")), "")).alias("n")).collect()
    assert time.perf_counter() - start < 8
    assert kept[1]["n"] - kept[0]["n"] >= len("x.orgb@c.de")


def test_emoji_sequences(spark):
    """A sequence has one name, next to text, digits and other sequences."""
    rows = [
        (name, symbols, f"5{symbols}\u2764\uFE0F:{symbols}x") for symbols, name in EMOJI_SEQUENCES
    ]
    found = spark.createDataFrame(rows, "name string, alone string, inside string").select(
        "name",
        find_emoji(F.col("alone")).alias("alone"),
        find_emoji(F.col("inside")).alias("inside"),
        markers.mark_emoji(F.col("inside")).alias("marked"),
        markers.mark_emoji_named(F.col("alone")).alias("named"),
    )
    found = found.collect()
    assert len(found) == len(EMOJI_SEQUENCES) >= 30
    for r in found:
        assert r.alone == f":{r.name}:"
        assert r.inside == f":{r.name}:,:heavy_black_heart:,:{r.name}:"
        assert r.marked == "5 xxemoji  xxemoji : xxemoji x"
        assert r.named == f" xxemoji {r.name.replace('_', '')} "


def test_emoji_beside_each_other(one):
    """Letters of flags pair from the left; a joiner without a part after it stays."""
    flags = "\U0001F1FA\U0001F1F8\U0001F1E9\U0001F1EA\U0001F1EB"
    assert one(find_emoji, flags) == ":flag_us:,:flag_de:,:regional_indicator_symbol_letter_f:"
    assert one(markers.mark_emoji, "\U0001F469\u200Dx") == " xxemoji \u200Dx"
    assert one(find_emoji, "1 #2 * 10:30") is None
    assert one(find_emoji, None) is None
    assert one(find_emoji, "") is None
    long = "\U0001F468" + "\u200D\U0001F469" * 20_000
    assert one(markers.mark_emoji, long) == " xxemoji "
    assert one(find_emoji, long).count("woman") == 20_000
