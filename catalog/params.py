"""Parameters shared by the queries and their SQL: the test texts are not Indonesian."""

from wartaframe.functions.direction import DirectionRules

STOPWORDS = [
    "the", "and", "with", "that", "for", "was", "are", "les", "des", "une", "est",
    "que", "qui", "pour", "dans", "der", "die", "und", "von", "den", "das", "los",
    "las", "una", "por", "con", "para",
]
KEYWORD = "the of"
EXTRA_STOPWORDS = "tion, Ent"
YEAR, MONTH = 2024, "Januari"
SLANG = {"thand": "than d", "ing": "tion", "eux": "eau pour"}
AFFIXES = ((r"^(.{3,})(?:tion|ment|ing)$", "$1"), (r"^(?:re|en)(.{4,})$", "$1"))
GENERIC = ["ent", "eau", "ers"]
RULES = DirectionRules(
    up=("the", "that", "les", "der", "los"),
    down=("and", "with", "des", "und", "con"),
    negative_if_up=("ere", "ing", "eau", "lich"),
    positive_if_up=("tion", "ble", "ment", "heit"),
)
THRESHOLD = 0.85
LEXICON_DOCS = 20
PHRASE_DOCS = 15
POOL = 100
LIMIT = 150
SEED = 42
