"""Lexicons as data.

Operators receive a lexicon as rows ``(category, section, pattern, kind)`` with
``kind`` in ``regex`` / ``substring`` / ``word``; nothing below is hard-coded
inside an operator.  Regex and substring lexicons are small (tens of patterns)
and are unrolled into literal ``regexp_count`` / ``replace`` columns so each
pattern is compiled once per task; word lexicons can be large and are joined.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    category: str
    pattern: str
    kind: str = "regex"
    section: str | None = None


# ---------------------------------------------------------------------------
# Depressive linguistic marker taxonomy (case-insensitive regexes;
# a category's count is the sum over its patterns of non-overlapping matches).
DEPRESSIVE_MARKERS = {
    "absolutist": [
        r"\b(absolutely|all|always|complete|completely|constant|constantly)\b",
        r"\b(definitely|entire|ever|every|everyone|everything|full)\b",
        r"\b(must|never|nothing|totally|whole)\b",
    ],
    "depressive_words": [
        r"\b(depression|collapse|stress|suicide|apastia|anxious|sad|tired)\b",
        r"\b(death|lonely|insomnia|bad|desperate|give up|low|leave)\b",
        r"\b(fear|danger|close|sensitive|lost|shadow|destroy|suspect)\b",
        r"\b(crash|dark|helpless|guilt|negative|frustration|nervous)\b",
        r"\b(melancholy|rubbish|jump|forget|goodbye|cut wrist|edge|haze)\b",
        r"\b(antidepressant)\b",
    ],
    "non_fluencies": [
        r"\b(uh|um|er|ah|eh|oh|hmm|mm|mmm)\b",
        r"\b(you know|y'know|i mean|let's see)\b",
    ],
    "first_person_singular": [r"\bI\b", r"\bme\b", r"\bmine\b", r"\bmy\b", r"\bmyself\b"],
    "social_pronouns": [r"\bwe\b", r"\bus\b", r"\bour\b", r"\bours\b", r"\bourselves\b"],
}
# Categories left out of the per-token and %-of-messages tables (used for the ratio).
PRONOUN_CATEGORIES = ("first_person_singular", "social_pronouns")

# Disfluency substrings counted on lower-cased text (overlaps between
# entries are counted, e.g. "um" inside "umm" and inside "number").
DISFLUENCIES = [
    "uh", "um", "umm", "erm", "hmm", "mm", "ah", "ahh", "eh", "ehh",
    "uh huh", "mm hmm", "mhm",
    "you know",
    "i mean",
    "[sigh]", "[deep breath]", "[crying]", "[sniff]", "[pause]",
    "[laughs]", "[clears throat]",
]

# Linguistic markers (regex on lower-cased text) and their sections.
LINGUISTIC_MARKERS = {
    "i": r"\bi\b",
    "me": r"\bme\b",
    "my": r"\bmy\b",
    "myself": r"\bmyself\b",
    "we": r"\bwe\b",
    "us": r"\bus\b",
    "our": r"\bour\b",
    "always": r"\balways\b",
    "never": r"\bnever\b",
    "all_or_nothing": r"\b(always|never|nothing|everything)\b",
    "universal_negative": r"\b(no one|everyone|nobody|anybody)\b",
    "should": r"\bshould\b",
    "must": r"\bmust\b",
    "cant": r"\bcan't\b|\bcannot\b",
    "blame_words": r"\b(fault|blame)\b",
    "negative_feelings": r"\b(sad|hopeless|tired|anxious|scared|empty|worthless)\b",
    "uncertainty": r"\b(maybe|i think|i guess|possibly|not sure)\b",
    "helplessness": r"\b(i can't|i don't know|can't handle)\b",
    "rumination": r"\b(again|keep thinking|stuck|can't stop)\b",
    "self_inadequacy": r"\b(should have|not enough|never enough|not worth)\b",
    "extreme_words": r"\b(terrible|worthless|hopeless|awful|failure)\b",
}
MARKER_SECTIONS = {
    "i": "Self-focus",
    "me": "Self-focus",
    "my": "Self-focus",
    "myself": "Self-focus",
    "we": "Social/connection",
    "us": "Social/connection",
    "our": "Social/connection",
    "always": "Cognitive distortions",
    "never": "Cognitive distortions",
    "all_or_nothing": "Cognitive distortions",
    "universal_negative": "Cognitive distortions",
    "should": "Cognitive distortions",
    "must": "Cognitive distortions",
    "cant": "Cognitive distortions",
    "blame_words": "Cognitive distortions",
    "negative_feelings": "Neg and extreme emotion words",
    "uncertainty": "Uncertainty/helplessness",
    "helplessness": "Uncertainty/helplessness",
    "rumination": "Rumination",
    "self_inadequacy": "Self-deprecation/inadequacy",
    "extreme_words": "Neg and extreme emotion words",
}

# Disfluency tokens removed by the strict preprocess (lexical diversity).
STRICT_DISFLUENCIES = ["um", "uh", "hm", "hmm", "ah", "er", "mm", "mhm", "huh"]

# English stop words (the common NLTK list, 179 words).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o",
    "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't",
    "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Plutchik's eight emotions in the fixed reporting order.
EMOTIONS = ["anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust"]

# A small English emotion word list of our own (word, emotion); a real run passes a
# full lexicon table instead.  A word may carry several emotions.
EMOTION_WORDS = [
    ("angry", "anger"), ("furious", "anger"), ("hate", "anger"), ("annoyed", "anger"), ("rage", "anger"),
    ("hope", "anticipation"), ("expect", "anticipation"), ("plan", "anticipation"), ("soon", "anticipation"),
    ("wait", "anticipation"), ("disgusting", "disgust"), ("gross", "disgust"), ("sick", "disgust"),
    ("awful", "disgust"), ("afraid", "fear"), ("scared", "fear"), ("anxious", "fear"), ("worry", "fear"),
    ("panic", "fear"), ("nervous", "fear"), ("happy", "joy"), ("glad", "joy"), ("love", "joy"),
    ("good", "joy"), ("hope", "joy"), ("sad", "sadness"), ("lonely", "sadness"), ("cry", "sadness"),
    ("lost", "sadness"), ("tired", "sadness"), ("hopeless", "sadness"), ("empty", "sadness"),
    ("surprised", "surprise"), ("sudden", "surprise"), ("unexpected", "surprise"), ("shock", "surprise"),
    ("trust", "trust"), ("friend", "trust"), ("support", "trust"), ("safe", "trust"), ("honest", "trust"),
]


def depressive_lexicon() -> list[Entry]:
    return [Entry(cat, p, "regex", cat) for cat, pats in DEPRESSIVE_MARKERS.items() for p in pats]


def linguistic_lexicon() -> list[Entry]:
    return [Entry(name, p, "regex", MARKER_SECTIONS.get(name)) for name, p in LINGUISTIC_MARKERS.items()]


def disfluency_lexicon(mode: str = "substring") -> list[Entry]:
    """``substring`` (faithful: "um" also counts inside "number" and "umm") or
    ``word`` (whole-word occurrences only)."""
    if mode not in ("substring", "word"):
        raise ValueError(mode)
    return [Entry(d, d, mode, "Disfluency") for d in DISFLUENCIES]


#: Entries that a lexicon given as a DataFrame may have: it is a parameter of the plan.
MAX_ENTRIES = 100_000


def as_rows(entries) -> list[Entry]:
    """Accept a list of Entry / tuples or a DataFrame of them: the patterns become
    expressions of the plan, so a lexicon is a parameter, not data (word lists
    of any size are joined instead, see ``operators.emotion``).  A DataFrame of
    more than ``MAX_ENTRIES`` rows is refused."""
    if hasattr(entries, "collect"):
        entries = entries.limit(MAX_ENTRIES + 1).collect()
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"a lexicon may have {MAX_ENTRIES} entries; join longer word lists instead")
        return [Entry(r["category"], r["pattern"], r["kind"] if "kind" in r else "regex",
                      r["section"] if "section" in r else None) for r in entries]
    out = []
    for e in entries:
        out.append(e if isinstance(e, Entry) else Entry(*e))
    return out


def lexicon_frame(spark, entries):
    """The lexicon as a DataFrame ``(category, section, pattern, kind)``."""
    rows = [(e.category, e.section, e.pattern, e.kind) for e in as_rows(entries)]
    return spark.createDataFrame(rows, "category string, section string, pattern string, kind string")
