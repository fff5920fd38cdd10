"""Values that decide results and therefore may not vary."""

# ---- fixed values: character classes shared by all patterns -----------------
# Java's \w and \s are ASCII-only, so the Unicode classes are spelled out.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE_OR_COLON = r"[^\s\x1c-\x1f\x85\p{Z}:]"

# ---- fixed values: punctuation sets -----------------------------------------
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKER_PUNCTUATION = "!\"$%&'()*+,-./:;<=>?[\\]^_`{|}~…–”“’"
BAG_PUNCTUATION = ASCII_PUNCTUATION + "…–"
BAG_DROPPED_CHARACTERS = "():.…,“–"

# ---- fixed values: pictographs ----------------------------------------------
EMOJI_RANGES = [
    (0xA9, 0xA9),
    (0xAE, 0xAE),
    (0x203C, 0x203C),
    (0x2049, 0x2049),
    (0x2122, 0x2122),
    (0x2139, 0x2139),
    (0x2194, 0x21AA),
    (0x231A, 0x23FF),
    (0x25AA, 0x25FE),
    (0x2600, 0x27BF),
    (0x2934, 0x2935),
    (0x2B05, 0x2B55),
    (0x1F004, 0x1F0CF),
    (0x1F170, 0x1F251),
    (0x1F300, 0x1FAFF),
]
# The outer range turns most characters away with one comparison.
EMOJI_CLASS = (
    r"[\x{A9}\x{AE}[\x{203C}-\x{1FAFF}&&["
    + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES)
    + r"]]]"
)
# Joiner and signs inside a sequence, skin tones, letters of flags, tags of regions.
EMOJI_JOINER = r"\x{200D}"
EMOJI_SIGNS = r"\x{FE0F}\x{20E3}"
SKIN_TONES = [
    "light_skin_tone",
    "medium-light_skin_tone",
    "medium_skin_tone",
    "medium-dark_skin_tone",
    "dark_skin_tone",
]
FIRST_SKIN_TONE, FIRST_FLAG_LETTER, FIRST_TAG, LAST_TAG = 0x1F3FB, 0x1F1E6, 0xE0020, 0xE007F
KEYCAP = r"[0-9#*]\x{FE0F}?+\x{20E3}"
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
# One pictograph with its variation selector, skin tone, region tags and joined parts. The
# grammar of emoji sequences in Unicode Technical Standard 51, the longest form first.
EMOJI_PART = (
    EMOJI_CLASS
    + rf"[{EMOJI_SIGNS}\x{{1F3FB}}-\x{{1F3FF}}]*+"
    + r"(?:[\x{E0020}-\x{E007E}]++\x{E007F})?+"
)
EMOJI = f"(?:{KEYCAP}|{FLAG}|{EMOJI_PART}(?:{EMOJI_JOINER}{EMOJI_PART})*+)"

# ---- fixed values: marker rewrites, in the order they apply ------------------
NEWLINES = (r"\n+", " ")
DISEASE_NAME = (r"(?iu)corona[\s]?virus", "coronavirus")
DISEASE_NAME_WIDE = (r"(?iu)corona(?:[\s]?virus)?", "coronavirus")
DISEASE_NAME_TAG = rf"(?iu)#coronavirus(?!{WORD})"
DISEASE_CODE = (r"(?iu)covid(?:[-\s_]?19)?", "covid19")
DISEASE_CODE_NARROW = (r"(?iu)covid[-\s_]?19", "covid19")
DISEASE_CODE_REPEATED = (r"(?iu)(?:covid[-\s]?19)++", "covid19")
DISEASE_CODE_TAG = r"(?iu)#covid[_-]?19"
VIRUS_CODE = (r"(?iu)sars[-]?cov[-]?2", "sarscov2")
WHOLE_HASHTAG = (rf"#{NOT_SPACE_OR_COLON}+", "xxhashtag")
WHOLE_MENTION = (rf"@{NOT_SPACE_OR_COLON}+", "xxuser")
PICTURE_LINK = rf"(?iu)pic\.twitter\.com/{WORD}+"
VIDEO_LINK = rf"(?iu)https://(?:youtu\.be/|www\.youtube\.){NOT_SPACE}+"
SCHEME_LINK = rf"(?iu)(?:https?|ftp)://{NOT_SPACE}+"
SCHEME_OR_WWW_LINK = rf"(?iu)(?:(?:https?|ftp)://{NOT_SPACE}+|www\.{NOT_SPACE}*{WORD})"
BARE_DOMAIN = rf"{WORD}{NOT_SPACE}*\.[a-zA-Z+]{{2,3}}"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)*"

# The same patterns as the JVM runs them fast: a look at the first character, one look
# ahead for the dot, and a test of the character before.
FAST_SCHEME_OR_WWW_LINK = f"(?=[hfwHFW]){SCHEME_OR_WWW_LINK}"
FAST_SCHEME_LINK = f"(?=[hfHF]){SCHEME_LINK}"
# Tried once per run of non-space characters, so a run of any length costs one pass.
FAST_BARE_DOMAIN = (
    rf"(?<!{NOT_SPACE})([^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}]*+)"
    rf"(?=[^\s\x1c-\x1f\x85\p{{Z}}.]*+\.){BARE_DOMAIN}"
)
FAST_NUMBER = rf"(?=[-0-9])(?<!{NOT_SPACE})-?[0-9]++(?:\.[0-9]++)*+"

# ---- fixed values: repairs after tokenising, in the order they apply ---------
QUOTES_BEFORE_TOKENS = [("’", "'"), ("…", "...")]
CONTRACTIONS = [
    ("cannot ", "can not "),
    ("n't ", " n't "),
    ("n 't ", " n't "),
    ("ca n't", "can't"),
    ("ai n't", "ain't"),
    ("'m ", " 'm "),
    ("'re ", " 're "),
    ("'s ", " 's "),
    ("'ll ", " 'll "),
    ("'d ", " 'd "),
    ("'ve ", " 've "),
]
DAY_HALVES = [
    (" p . m .", "  p.m."),
    (" p . m ", " p.m "),
    (" a . m .", " a.m."),
    (" a . m ", " a.m "),
]
DIGIT_JOINS = [
    (r",([0-9]{2,4}) , ([0-9]{2,4})", ",$1,$2"),
    (r"([0-9]{1,3}) / ([0-9]{2,4})", "$1/$2"),
    (r"([0-9]{1,3})- ([0-9]{2,4})", "$1-$2"),
]

# ---- fixed values: topics and the terms that mark them -----------------------
TOPICS = {
    "newline": r"\n+",
    "china": r"(?iu)china|chinese",
    "usa": r"(?iu)usa|united states|america|american",
    "bioweapon": r"(?iu)(?:bio[\s]?weapon[s]?)++|biological weapon[s]?",
    "usa_bioweapon": (
        r"(?iu)(?:american|america|united states|usa)++|(?:bio[\s]?weapon[s]?)++"
        r"|biological weapon[s]?"
    ),
    "qanon": r"(?iu)jord[ae]n sath[ae]r|(?:q(?:\s)?anon)++",
    "boiled_ginger": r"(?iu)boiled|(?:ginger)++|empty|(?:stomach)++",
    "fiveg": (
        r"(?iu)(?:5[\s]?G)++|(?:network)++|(?:(?:tele)?phone)++|(?:signal(?:s)?)++|(?:radiation)++"
    ),
    "fiveg_cause": r"(?iu)(?:5[\s]?G)++|(?:cause[s]?)++",
    "flu": r"(?iu)flu",
    "silver": r"(?iu)silver",
}
# Letters a hit of the topic starts with, in either case.
TOPIC_STARTS = {
    "china": "c",
    "usa": "ua",
    "bioweapon": "b",
    "usa_bioweapon": "uab",
    "qanon": "jq",
    "boiled_ginger": "bges",
    "fiveg": "5ntpsr",
    "fiveg_cause": "5c",
}
# The same topics with a look at the first letter, which passes over most characters.
FAST_TOPICS = {
    name: (
        f"(?iu)(?=[{TOPIC_STARTS[name]}])(?:{pattern.removeprefix('(?iu)')})"
        if name in TOPIC_STARTS
        else pattern
    )
    for name, pattern in TOPICS.items()
}
TOPIC_PLAIN_COUNTS = {
    "china": r"(?iu)china",
    "fiveg": r"(?iu)5g",
    "bioweapon": r"(?iu)bioweapon",
    "flu": r"(?iu)flu",
    "silver": r"(?iu)silver",
}
NO_TOPIC = "N/a"
# Topics whose list says so when there is no hit; the lists of the others are empty.
TOLD_TOPICS = ["china", "usa"]

# ---- fixed values: sizes and seeds --------------------------------------------
MAX_POST_LENGTH = 330
SEED = 8
SVD_FRACTION = 0.01
PRECISION_K = 25
NARRATIVE_COUNT = 20
MISSING = "none"
