"""Lexicons for the driver's generated corpus.

The generated text has none of the English marker words, so the registered
D-checked queries run the same operators with these corpus lexicons; the real
English lexicons (``talkframe.lexicons``) are proven on authored fixtures in
``tests/``.
"""

from talkframe.lexicons import Entry

# Fixed values (ours): regex categories named like the depressive taxonomy.
CORPUS_MARKERS = [
    Entry("absolutist", r"\b(the|and)\b"), Entry("absolutist", r"\b(of)\b"),
    Entry("depressive_words", r"\b(la|le|de)\b"), Entry("depressive_words", r"\b(die|der|und)\b"),
    Entry("non_fluencies", r"\b(er)\b"), Entry("non_fluencies", r"\b(in the|ci)\b"),
    Entry("first_person_singular", r"\bon\b"), Entry("first_person_singular", r"\bfor\b"),
    Entry("social_pronouns", r"\ben\b"), Entry("social_pronouns", r"\bzu\b"),
]

# Fixed values (ours): substring "disfluencies" present in the generated text.
CORPUS_DISFLUENCIES = [Entry(d, d, "substring") for d in ["er", "en", "th", "ch", "the", "in the", "ou", "[x]"]]

# Fixed values (ours): lower-case regex markers with sections ("ci" has none → Other).
CORPUS_LINGUISTIC = [
    Entry("the", r"\bthe\b", "regex", "Self-focus"),
    Entry("of", r"\bof\b", "regex", "Self-focus"),
    Entry("and", r"\band\b", "regex", "Social/connection"),
    Entry("de_la", r"\b(de|la)\b", "regex", "Cognitive distortions"),
    Entry("der_die", r"\b(der|die|das)\b", "regex", "Cognitive distortions"),
    Entry("in_the", r"\bin the\b", "regex", "Rumination"),
    Entry("ci", r"\bci\b|\bque\b", "regex", None),
]
