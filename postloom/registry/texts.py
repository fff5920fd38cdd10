from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import bag, fixed, markers, normalise, words
from postloom.functions.emoji import find_emoji, name_emoji
from postloom.operators.clean import prepare_for_encoding
from postloom.registry.base import (
    POST_SQL,
    in_list,
    posts,
    query,
    rx,
    swap,
    table,
    text_literal,
)

# Function words of the four languages of the tables, for the queries that drop them.
STOP_WORDS = ["the", "of", "and", "that", "is", "to", "The", "der", "die", "und", "de", "la", "le", "los"]

EMOJI_ONE = "[🧐👍]"


def register(name, column, sql):
    """A text function over all posts, next to the same rewrite in SQL."""

    @query(name, f"with p as (select doc_id, {POST_SQL} as t from documents)\n"
                 f"select doc_id, {sql} as clean from p")
    def run(spark, sf_dir):
        return posts(spark, sf_dir).select("doc_id", column(F.col("post")).alias("clean"))

    return run


# ---- single steps --------------------------------------------------------------------

NEWLINE = rx("t", *fixed.NEWLINES)
register("newline_clean", markers.newlines_to_space, NEWLINE)
register("disease_name", markers.unify_disease_name, rx("t", *fixed.DISEASE_NAME))
register(
    "disease_name_wide",
    lambda c: markers.unify_disease_name(c, wide=True),
    rx("t", *fixed.DISEASE_NAME_WIDE),
)
TAG_NAME = r"(?i)#coronavirus\b"
register("disease_name_tag", markers.mark_disease_name_tag, rx("t", TAG_NAME, "xxhash coronavirus"))
register(
    "disease_name_tag_joined",
    lambda c: markers.mark_disease_name_tag(c, joined=True),
    rx("t", TAG_NAME, "xxhashcoronavirus"),
)
register("disease_code", markers.unify_disease_code, rx("t", *fixed.DISEASE_CODE))
register(
    "disease_code_narrow",
    lambda c: markers.unify_disease_code(c, narrow=True),
    rx("t", *fixed.DISEASE_CODE_NARROW),
)
register(
    "disease_code_tag",
    markers.mark_disease_code_tag,
    rx("t", fixed.DISEASE_CODE_TAG, "xxhash covid19"),
)
register("virus_code", markers.unify_virus_code, rx("t", *fixed.VIRUS_CODE))
register("hashtag_sign", markers.mark_hashtags, swap("t", "#", "xxhash "))
register("hashtag_drop", lambda c: markers.mark_hashtags(c, "drop"), swap("t", "#", ""))
register("hashtag_whole", lambda c: markers.mark_hashtags(c, "whole"), rx("t", *fixed.WHOLE_HASHTAG))
register("mention_sign", markers.mark_mentions, swap("t", "@", "xxmention "))
register("mention_whole", lambda c: markers.mark_mentions(c, "whole"), rx("t", *fixed.WHOLE_MENTION))
NAMED = swap(swap("t", "🧐", " xxemoji facewithmonocle "), "👍", " xxemoji thumbsupsign ")
register("emoji_named", markers.mark_emoji_named, NAMED)
register("emoji_marker", markers.mark_emoji, rx("t", EMOJI_ONE, " xxemoji "))
register("picture_link", markers.mark_picture_links, rx("t", fixed.PICTURE_LINK, " xxpictwit "))
register("video_link", markers.mark_video_links, rx("t", fixed.VIDEO_LINK, " xxyoutubeurl "))
BARE = fixed.BARE_DOMAIN
LINKS = rx("t", fixed.SCHEME_OR_WWW_LINK, " xxurl ")
register("link_marker", markers.mark_links, rx(LINKS, BARE, " xxurl "))
register("link_marker_strict", lambda c: markers.mark_links(c, bare_domains=False), LINKS)
register("link_scheme_only", markers.mark_scheme_links, rx("t", fixed.SCHEME_LINK, "xxurl"))


def numbers_marked(expression):
    pattern = rf"(^|{fixed.SPACE}){fixed.NUMBER}"
    return rx(expression, pattern, "$1<number>").replace("<number>", "$NUMBER$")


register("number_marker", markers.mark_numbers, numbers_marked("t"))


def spaced(expression, characters):
    return rx(rx(expression, f"({words.class_of(characters)})", " $1 "), "[ ]{2,}", " ")


SYMBOL = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


def punctuated(expression, marker, characters):
    return rx(rx(spaced(expression, characters), SYMBOL, marker), "[ ]{2,}", " ")


PUNC = fixed.MARKER_PUNCTUATION
register("punct_space", markers.space_punctuation, spaced("t", PUNC))
register("punct_marker", markers.mark_punctuation, punctuated("t", "xxpunc", PUNC))
register("punct_drop", lambda c: markers.mark_punctuation(c, ""), punctuated("t", "", PUNC))


def word_list(expression):
    return (
        f"list_filter(regexp_split_to_array({expression}, {text_literal(fixed.SPACE + '+')}), "
        "lambda w: w <> '')"
    )


def without_stop(expression):
    return f"list_filter({expression}, lambda w: w not in {in_list(STOP_WORDS)})"


def joined(expression):
    return f"array_to_string({expression}, ' ')"


def piped(expression):
    """Arrays are compared as text."""
    return f"array_to_string({expression}, '|')"


def stripped(expression, characters):
    return f"translate({expression}, {text_literal(characters)}, '')"


register("token_array", lambda c: F.array_join(words.words(c), "|"), piped(word_list("t")))
register(
    "stopword_drop",
    lambda c: words.remove_stop_words(words.words(c), STOP_WORDS),
    joined(without_stop(word_list("t"))),
)
register(
    "short_word_drop",
    lambda c: F.array_join(words.drop_short_words(words.words(c), 1), " "),
    joined(f"list_filter({word_list('t')}, lambda w: length(w) > 1)"),
)
PLAIN = joined(f"list_transform({without_stop(word_list('t'))}, lambda w: {stripped('w', PUNC)})")
register("plain_words", lambda c: markers.plain_words(c, STOP_WORDS), PLAIN)

# ---- whole cleanings -------------------------------------------------------------------

V2 = NEWLINE
for pattern, replacement in [
    fixed.DISEASE_NAME,
    (TAG_NAME, "xxhash coronavirus"),
    fixed.DISEASE_CODE,
    (fixed.DISEASE_CODE_TAG, "xxhash covid19"),
    fixed.VIRUS_CODE,
]:
    V2 = rx(V2, pattern, replacement)
V2 = swap(swap(V2, "#", "xxhash "), "@", "xxmention ")
V2 = swap(swap(V2, "🧐", " xxemoji facewithmonocle "), "👍", " xxemoji thumbsupsign ")
V2 = rx(rx(V2, fixed.PICTURE_LINK, " xxpictwit "), fixed.VIDEO_LINK, " xxyoutubeurl ")
V2 = rx(rx(V2, fixed.SCHEME_OR_WWW_LINK, " xxurl "), BARE, " xxurl ")
V2_WORDS = joined(f"list_transform({without_stop(word_list(V2))}, lambda w: {stripped('w', PUNC)})")


def trimmed(expression):
    return f"trim({rx(expression, '[ ]{2,}', ' ')})"


register("marker_clean", markers.clean_markers, trimmed(V2))
register(
    "marker_clean_words",
    lambda c: markers.clean_markers(c, strip_words=True, stop_words=STOP_WORDS),
    trimmed(V2_WORDS),
)
register(
    "marker_clean_punct",
    lambda c: markers.clean_markers(c, punctuation=True),
    trimmed(punctuated(V2, "xxpunc", PUNC)),
)

OLD_PUNC = fixed.ASCII_PUNCTUATION + "…–”“’"
OLD = NEWLINE
for pattern, replacement in [
    fixed.DISEASE_NAME,
    (TAG_NAME, "xxhashcoronavirus"),
    fixed.DISEASE_CODE_NARROW,
    (fixed.DISEASE_CODE_TAG, "xxhashcovid19"),
    fixed.VIRUS_CODE,
]:
    OLD = rx(OLD, pattern, replacement)
OLD = swap(swap(OLD, "#", ""), "@", "")
OLD_NUMBERS = numbers_marked(OLD)
OLD_NUMBERS = punctuated(rx(OLD_NUMBERS, EMOJI_ONE, " xxemoji "), "", OLD_PUNC)
OLD_NUMBERS = joined(f"list_filter({word_list(OLD_NUMBERS)}, lambda w: length(w) > 1)")
OLD = rx(OLD, EMOJI_ONE, " xxemoji ")
OLD = rx(rx(OLD, fixed.PICTURE_LINK, "xxpictwit"), fixed.VIDEO_LINK, "xxyoutubeurl")
OLD = rx(OLD, fixed.SCHEME_LINK, "xxurl")
register("marker_clean_joined", markers.clean_markers_joined, trimmed(OLD))
register(
    "marker_clean_joined_words",
    lambda c: markers.clean_markers_joined(c, strip_words=True),
    trimmed(stripped(joined(word_list(OLD)), OLD_PUNC)),
)
register(
    "marker_clean_joined_numbers",
    lambda c: markers.clean_markers_joined(c, punctuation=True, numbers=True),
    OLD_NUMBERS,
)

V1 = rx(rx(NEWLINE, fixed.PICTURE_LINK, "xxpictwit"), fixed.VIDEO_LINK, "xxyoutubeurl")
V1 = rx(V1, fixed.SCHEME_LINK, "xxurl")
V1 = rx(rx(V1, *fixed.WHOLE_MENTION), *fixed.WHOLE_HASHTAG)
V1 = rx(V1, EMOJI_ONE, " xxemoji ")
register("marker_clean_first", markers.clean_markers_first, V1)

# ---- normalisation for an encoder -------------------------------------------------------


def chain(expression, pairs):
    for old, new in pairs:
        expression = swap(expression, old, new)
    return expression


QUOTED = chain("t", fixed.QUOTES_BEFORE_TOKENS)


def tokens_of(expression):
    return f"regexp_extract_all({expression}, {text_literal(normalise.TOKEN)})"


def rewritten(expression):
    out = rx(expression, "(^| )@[^ ]*", "$1@USER")
    out = rx(out, "(?i)(^| )(?:http|www)[^ ]*", "$1HTTPURL")
    return swap(swap(out, "🧐", ":face_with_monocle:"), "👍", ":thumbs_up_sign:")


def digits(expression):
    for pattern, replacement in fixed.DIGIT_JOINS:
        expression = rx(expression, pattern, replacement)
    return expression


def squeezed(expression):
    return f"trim({rx(expression, fixed.SPACE + '+', ' ')})"


NORMAL = rewritten(joined(tokens_of(QUOTED)))
NORMAL = squeezed(digits(chain(chain(NORMAL, fixed.CONTRACTIONS), fixed.DAY_HALVES)))
register("plain_quotes", normalise.plain_quotes, QUOTED)
register(
    "post_tokens", lambda c: F.array_join(normalise.post_tokens(c), "|"), piped(tokens_of("t"))
)
register("token_rewrite", normalise.rewrite_tokens, rewritten("t"))
register("contractions", normalise.repair_contractions, chain("t", fixed.CONTRACTIONS))
register("day_halves", normalise.repair_day_halves, chain("t", fixed.DAY_HALVES))
register("digit_rejoin", normalise.rejoin_digits, digits("t"))
register("squeeze_lower", lambda c: F.lower(normalise.squeeze(c)), f"lower({squeezed('t')})")
register("normalise_post", normalise.normalise_post, f"lower({NORMAL})")


@query(
    "normalise_posts",
    f"""with p as (select doc_id, lang, {POST_SQL} as t from documents)
select doc_id, t as full_text, lower({NORMAL}) as normalized_tweet from p
where lang = 'en' and length(t) <= 5000""",
)
def normalise_posts(spark, sf_dir):
    """English posts below a length; the usual limit would leave few documents."""
    rows = posts(spark, sf_dir).select("doc_id", "lang", F.col("post").alias("full_text"))
    return prepare_for_encoding(rows, limit=5000).drop("lang")


# ---- bags of words -----------------------------------------------------------------------


def removed(expression, *patterns):
    for pattern in patterns:
        expression = rx(expression, pattern, "")
    return expression


def not_within(expression, symbols):
    return f"list_filter({expression}, lambda w: not contains({text_literal(symbols)}, w))"


BAG = rx(removed("t", EMOJI_ONE), *fixed.NEWLINES)
BAG = stripped(removed(BAG, bag.MENTION, bag.HASHTAG, bag.LINK), fixed.BAG_DROPPED_CHARACTERS)
register(
    "bag_of_words_clean",
    lambda c: F.array_join(bag.bag_of_words(c), "|"),
    piped(not_within(word_list(BAG), fixed.BAG_PUNCTUATION)),
)
register("pattern_remove", lambda c: bag.remove_pattern(c, "[Tt]he", True), rx("t", "[Tt]he", " "))

LETTERS = rx(rx(NEWLINE, rf"@{fixed.WORD}*", ""), "[^a-zA-Z#]", " ")
LETTERS = joined(f"list_filter({word_list(LETTERS)}, lambda w: length(w) > 3)")
LETTERS = swap(rx(LETTERS, rf"http{fixed.NOT_SPACE}+", ""), "#", "")
register(
    "letters_only",
    lambda c: bag.letters_only(c, STOP_WORDS),
    joined(without_stop(word_list(f"lower({LETTERS})"))),
)
register("ascii_fold", bag.ascii_only, rx("t", r"[^\x00-\x7F]", ""))


def normal_words(expression):
    out = rx(expression, *fixed.DISEASE_CODE_REPEATED)
    out = rx(rx(out, *fixed.DISEASE_NAME_WIDE), r"[^\x00-\x7F]", "")
    out = word_list(f"lower({spaced(out, fixed.ASCII_PUNCTUATION)})")
    return rx(joined(without_stop(not_within(out, fixed.BAG_PUNCTUATION))), "[ ]{2,}", " ")


register("normalise_words", lambda c: bag.normalise_words(c, STOP_WORDS), normal_words("t"))
register("clean_words", lambda c: bag.clean_words(c, STOP_WORDS), normal_words(V1))


@query(
    "joined_word_drop",
    rf"""with p as (select doc_id, rtrim(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')) as t from documents),
h as (select doc_id, replace(t, ' en ', '-en ') as t from p)
select doc_id, regexp_replace(t, '(^| )[\p{{L}}]+(-[\p{{L}}]*)+', '\1', 'g') as clean from h""",
)
def joined_word_drop(spark, sf_dir):
    """Plain words, some of them tied together by a hyphen."""
    plain = F.rtrim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    tied = F.replace(plain, F.lit(" en "), F.lit("-en "))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", bag.drop_joined_words(tied).alias("clean"))


@query(
    "emoji_list",
    f"""with p as (select doc_id, {POST_SQL} as t from documents)
select doc_id, ':face_with_monocle:,:thumbs_up_sign:' as emoji from p
where contains(t, '🧐')""",
)
def emoji_list(spark, sf_dir):
    rows = posts(spark, sf_dir).select("doc_id", find_emoji(F.col("post")).alias("emoji"))
    return rows.where(F.col("emoji").isNotNull())


# ---- fixed values: emoji sequences and their names by rule --------------------------
EMOJI_SEQUENCES = [
    ("\U0001F44D", "thumbs_up_sign"),
    ("\U0001F44D\U0001F3FB", "thumbs_up_sign_light_skin_tone"),
    ("\U0001F44D\U0001F3FC", "thumbs_up_sign_medium-light_skin_tone"),
    ("\U0001F44D\U0001F3FD", "thumbs_up_sign_medium_skin_tone"),
    ("\U0001F44D\U0001F3FE", "thumbs_up_sign_medium-dark_skin_tone"),
    ("\U0001F44D\U0001F3FF", "thumbs_up_sign_dark_skin_tone"),
    ("\U0001F3FD", "medium_skin_tone"),
    ("\u2764", "heavy_black_heart"),
    ("\u2764\uFE0F", "heavy_black_heart"),
    ("\u2764\uFE0F\u200D\U0001F525", "heavy_black_heart_fire"),
    ("\U0001F469\u200D\U0001F680", "woman_rocket"),
    ("\U0001F469\U0001F3FD\u200D\U0001F680", "woman_medium_skin_tone_rocket"),
    ("\U0001F468\u200D\U0001F469\u200D\U0001F467", "man_woman_girl"),
    ("\U0001F468\u200D\U0001F469\u200D\U0001F467\u200D\U0001F466", "man_woman_girl_boy"),
    ("\U0001F468\u200D\u2764\uFE0F\u200D\U0001F468", "man_heavy_black_heart_man"),
    ("\U0001F3C3\u200D\u2640\uFE0F", "runner_female_sign"),
    ("\U0001F3C3\U0001F3FF\u200D\u2642\uFE0F", "runner_dark_skin_tone_male_sign"),
    ("\U0001F3F3\uFE0F\u200D\U0001F308", "waving_white_flag_rainbow"),
    ("\U0001F408\u200D\u2B1B", "cat_black_large_square"),
    ("\U0001F43B\u200D\u2744\uFE0F", "bear_face_snowflake"),
    ("\U0001F1FA\U0001F1F8", "flag_us"),
    ("\U0001F1E9\U0001F1EA", "flag_de"),
    ("\U0001F1EB", "regional_indicator_symbol_letter_f"),
    (
        "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F",
        "waving_black_flag_gbeng",
    ),
    (
        "\U0001F3F4\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F",
        "waving_black_flag_gbsct",
    ),
    ("1\uFE0F\u20E3", "keycap_1"),
    ("9\u20E3", "keycap_9"),
    ("#\uFE0F\u20E3", "keycap_#"),
    ("*\uFE0F\u20E3", "keycap_*"),
    ("\u263A\uFE0F", "white_smiling_face"),
    ("\U0001F9D1\U0001F3FE\u200D\U0001F91D\u200D\U0001F9D1\U0001F3FB",
     "adult_medium-dark_skin_tone_handshake_adult_light_skin_tone"),
]


@query(
    "emoji_sequences",
    f"""with s(k, symbols, name) as (values {", ".join(
        f"({k}, {text_literal(symbols)}, {text_literal(name)})"
        for k, (symbols, name) in enumerate(EMOJI_SEQUENCES)
    )}),
p as (select doc_id, {POST_SQL} as t, s.* from documents join s on k = doc_id % {len(EMOJI_SEQUENCES)})
select doc_id, ':face_with_monocle:,:thumbs_up_sign:,:' || name || ':,:' || name || ':' as emoji,
       {swap(swap("t", "🧐", "<face_with_monocle>"), "👍", "<thumbs_up_sign>")}
       || ' 7 <' || name || '>a<' || name || '>' as named
from p""",
)
def emoji_sequences(spark, sf_dir):
    """Posts that end with one of the sequences, twice."""
    end = F.get(F.array(*[F.lit(s) for s, _ in EMOJI_SEQUENCES]), F.col("doc_id") % len(EMOJI_SEQUENCES))
    post = F.concat("post", F.lit(" 7 "), end, F.lit("a"), end)
    rows = posts(spark, sf_dir).select("doc_id", post.alias("post"))
    return rows.select(
        "doc_id",
        find_emoji(F.col("post")).alias("emoji"),
        name_emoji(F.col("post"), "<", ">", "_").alias("named"),
    )
