"""Fixed word tables of the registered queries, shared by both engines.

They are inputs of the operators, not part of them; a real run passes its own.
"""

STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "de", "la", "der", "die", "und", "et", "le", "les", "des", "en", "que",
    "el", "los",
)

LEXICON = (
    ("tion", 1), ("ing", 1), ("ea", 1), ("thon", 1), ("orantion", 1), ("pour", 1), ("für", 1), ("ble", 1), ("new", 1),
    ("hot", 1), ("er", 0), ("rewh", -1), ("th", -1), ("nd", -1), ("hehely", -1), ("inoran", -1), ("auf", -1),
    ("thth", -1), ("old", -1), ("cold", -1),
)

ENTITIES = (
    "thatin", "von", "La", "Orre", "of the", "that the", "the and", "de la", "the of the", "is a", "à", "ring",
    "red anvil",
)

STEMS = (
    ("thes", "th"), ("thed", "th"), ("thin", "th"), ("erin", "er"), ("eren", "er"), ("orantion", "oran"),
    ("inoran", "oran"), ("rings", "ring"), ("bolts", "bolt"),
)
