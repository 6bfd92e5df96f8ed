"""Parameters of the registered queries, shared by the Spark queries and their SQL counterparts."""

from pagesieve.schemas import Options
from pagesieve.sources.dictionary import EXPLICIT_WEIGHTS, build_dictionary

# The given texts are invented prose, so the spam dictionary gets some of their words and word parts: nested, overlapping
# and inner-word phrases with default and explicit weights.
EXTRA_PHRASES = (
    "ad", "rates", "the", "the th", "then", "tion", "mentou", "of the", "on.", "der ung", "ement", "ción", "para la",
    "keit", "eau", "eaux", "| re", "%%%", "&&&",
)
EXTRA_WEIGHTS = {"the th": 2, "tion": 3, "para la": 4, "eaux": 2, "%%%": 6, "keit": 2}
DICTIONARY = build_dictionary((*EXPLICIT_WEIGHTS, *EXTRA_PHRASES), {**EXPLICIT_WEIGHTS, **EXTRA_WEIGHTS})

# Function words of the four languages of the given texts.
STOP_WORDS = [
    "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "with", "de", "des", "du", "elle", "en", "et", "la", "le", "les", "pour", "que", "qui", "un", "une", "das",
    "der", "die", "ein", "ist", "mit", "und", "von", "zu", "con", "del", "el", "las", "los", "no", "para", "por", "una",
]

OPTIONS = Options(spam_threshold=9)
CRAWLED_AT = "2025-01-01 00:00:00"
