"""Normalisation that prepares a post for a sentence encoder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions.emoji import name_emoji

# Word-like units of a post, tried in this order at every position, as tokenizers of posts
# commonly do. Nothing is bounded: repetitions are over single characters, and a form that may
# run on for long without becoming a token begins only where its run of characters begins (RUNS),
# so a run is looked through once for each form and a text of any length is a few passes.
SUFFIXES = "com|org|net|edu|gov|info|io|co|uk|us|eu|de|fr|es"
TOKEN_FORMS = {
    "link": r"(?:https?://|www\.)[^\s]*[^\s.,;:!?\"')\]]",
    "bare_link": rf"[A-Za-z0-9][A-Za-z0-9.-]*\.(?:{SUFFIXES})\b(?:/[^\s]*)?",
    "face": r"[<>]?[:;=8][-o*']?[)\](\[dDpP/}{@|\\]|[)\](\[dDpP/}{@|\\][-o*']?[:;=8][<>]?",
    "markup": r"<[^<>\s]+>",
    "arrow": r"-+>|<-+",
    "handle": r"@[\p{L}\p{N}_]+",
    "hashtag": r"#+[\p{L}\p{N}_][\p{L}\p{N}_'-]*[\p{L}\p{N}_]|#+[\p{L}\p{N}_]",
    "mail": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "joined_word": r"\p{L}[\p{L}'_-]+\p{L}",
    "number": r"[+-]?\p{Nd}+[,/.:-]\p{Nd}+[+-]?",
    "word": r"[\p{L}\p{N}_]+",
    "dots": r"\.[\s.]*\.",
    "symbol": r"[^\s]",
}
# The same tokens as the JVM finds them fast: most words are letters before a space, and a
# look ahead refuses the costly forms early. Named classes run faster than mixed ranges.
FAST_STARTS = {
    "link": "(?=[hw])",
    # a host and a mailbox begin where their run does
    "bare_link": r"(?<![\p{Alnum}.-])(?=[\p{Alnum}-]++\.)",
    # a run of dashes or of # is looked through once, possessively, and only from its start
    "arrow": r"(?=<-|(?<!-)-++>)",
    "hashtag": r"(?=(?<!#)#++[\p{L}\p{N}_])",
    "mail": r"(?<![\p{Alnum}_.+-])(?=[\p{Alnum}_.+-]++@)",
    "number": r"(?=[+\p{Nd}-])",
}
# Dots and dashes before a host, which are tokens of their own.
BEFORE_HOST = (
    r"(?<![\p{Alnum}.-])([.-]++)(?=\p{Alnum}[\p{Alnum}.-]*\.(?:" + SUFFIXES + r")\b)"
)
TOKEN = "(?:" + "|".join(TOKEN_FORMS.values()) + ")"
FAST_TOKEN = (
    r"(?:\p{L}++(?=[ \n])|"
    + "|".join(FAST_STARTS.get(name, "") + f"(?:{form})" for name, form in TOKEN_FORMS.items())
    + ")"
).replace("A-Za-z0-9", r"\p{Alnum}")


def plain_quotes(text: Column) -> Column:
    return _replace_all(text, fixed.QUOTES_BEFORE_TOKENS)


def post_tokens(text: Column) -> Column:
    """Words, handles, links, tags, numbers, faces and single symbols, in order."""
    apart = F.regexp_replace(text, BEFORE_HOST, "$1 ")
    return F.regexp_extract_all(apart, F.lit(FAST_TOKEN), F.lit(0))


def rewrite_tokens(joined: Column) -> Column:
    """Handles, links and pictographs of a space-joined token list.

    Works on the joined text: three regex passes stay in generated code, a lambda per
    token would not.
    """
    out = F.regexp_replace(joined, r"@(?<![^ ]@)[^ ]*", "@USER")
    out = F.regexp_replace(out, r"(?=[hwHW])(?<![^ ])(?iu:http|www)[^ ]*", "HTTPURL")
    return name_emoji(out, ":", ":", "_")


def repair_contractions(text: Column) -> Column:
    return _replace_all(text, fixed.CONTRACTIONS)


def repair_day_halves(text: Column) -> Column:
    return _replace_all(text, fixed.DAY_HALVES)


def rejoin_digits(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), fixed.DIGIT_JOINS, text)


def squeeze(text: Column) -> Column:
    """Runs of white space to one space; a single space is left alone."""
    other = r"[[\s\x1c-\x1f\x85\p{Z}]&&[^ ]]"
    return F.trim(F.regexp_replace(text, f"{other}{fixed.SPACE}*+| {fixed.SPACE}++", " "))


def normalise_post(text: Column, lower: bool = True) -> Column:
    out = F.array_join(post_tokens(plain_quotes(text)), " ")
    out = rewrite_tokens(out)
    out = repair_contractions(out)
    out = repair_day_halves(out)
    out = squeeze(rejoin_digits(out))
    return F.lower(out) if lower else out


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
