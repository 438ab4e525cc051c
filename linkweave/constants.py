"""Values that results depend on."""

#: Words of legal forms and stop words that names are compared without.
LEGAL = (
    "inc incorporated corporation corp llc llp ltd limited private pvt company co plc pc the and of sa sas sarl eurl"
).split()

#: Abbreviations, each word with its short form.
ABBREVIATIONS = {
    "road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln",
    "court": "ct", "apartment": "apt", "suite": "ste", "floor": "fl", "building": "bldg", "highway": "hwy",
    "private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc", "centre": "center",
}

#: Forms of address that names are compared without.
HONORIFICS = "mr mrs ms shri sri smt".split()

#: Legal words whose phonetic forms are dropped.
PHONETIC_LEGAL = "private limited corporation incorporated company public".split()

#: Phonetic replacements, in order.
PHONETIC_STEPS = (
    ("sch", "s"), ("sh", "s"), ("ch", "s"), ("ph", "f"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"),
    ("bh", "b"), ("c", "k"), ("q", "k"), ("v", "w"), ("z", "j"), ("x", "ks"),
)

#: Scripts whose letters are romanised by their Unicode names.
INDIC_SCRIPTS = "DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM".split()

#: Thresholds of the two-source policy sweep.
POLICY_GRID = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.575, 0.65, 0.75, 0.85)

#: Patterns of what goes from a lower-cased name before its core is taken, in order.
NAME_NOISE = (
    r"\b(?:l\W*l\W*c|l\W*l\W*p|p\W*v\W*t)\b",
    r"https?://|www\.|\.(?:com|in|org|net)\b",
)
