"""Fixed values of claim extraction: sentence patterns, their hints, normalisation lists, synonyms and units.

A pattern is written with {E} (an entity), {A} (an attribute) and {V} (a value), each captured once; matching ignores
case. Hints are strings of which a padded, lower-cased segment must hold one for its pattern to be tried; patterns
beyond the hints are tried only on segments without any hint.
"""

from __future__ import annotations

import re

ENTITY = r"[A-Z][A-Za-z0-9&/@+.\-]*(?:\s+[A-Z0-9][A-Za-z0-9&/@+.\-]*)*"
ATTRIBUTE = r"[a-zA-Z_][a-zA-Z0-9_\-\s]*?"
VALUE = r"[^;\n]+?(?=\s*\.\s*$|\s*$)"

PATTERNS = [
    r"{E}\s+(?:reports|lists|states|shows|notes|confirms|records|indicates|specifies)\s+{A}\s+(?:as|is|at|to)\s+{V}",
    r"{E}\s+confirms\s+{A}\s+{V}",
    r"{E}\s+(?:is\s+set\s+to\s+release\s+in|will\s+(?:actually\s+)?be\s+released\s+in|will\s+now\s+release\s+in)\s+{V}",
    r"(?:the\s+)?screening\s+status\s+of\s+{E}\s+(?:is|was|remains)\s+(?:currently\s+)?{V}",
    r"(?:the\s+)?best\s+metric\s+for\s+{E}\s+(?:is|was|remains)\s+{V}",
    r"{E}'s\s+{A}\s+(?:is|was|remains)\s+{V}",
    r"{E}\s+has\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"{E}\s+(?:boasts|achieves)\s+(?:a|an|the)\s+{A}\s+of(?:\s+just)?\s+{V}",
    r"{E}\s+(?:shows|operates with|experiences|has shown|has been recorded with|reveals|exhibits)\s+(?:a|an|the)\s+{A}\s+of(?:\s+just|(?:\s+only)?)?\s+{V}",
    r"{E}\s+recorded\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"{E}\s+is\s+known\s+for\s+(?:its\s+)?(?:low\s+)?{A}\s+of\s+{V}",
    r"(?:for|within)\s+{E},\s+{A}\s+(?:is|was|remains)\s+{V}",
    r"(?:the\s+)?{A}\s+of\s+{E}\s+(?:is|was|remains)\s+{V}",
    r"(?:the\s+)?{A}\s+of\s+{E}\s+(?:is|was)\s+(?:measured at|recorded at|reported as|reported to be)\s+{V}",
    r"(?:the\s+)?{A}\s+for\s+{E}\s+(?:is|was|remains|is reported as|is reported to be|has been reported as|has been reported to be|has been measured at|is measured at|is recorded at|has been noted as|has increased to|has decreased to)\s+{V}",
    r"{E}\s+has\s+been\s+reported\s+to\s+have\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"(?:the\s+)?{A}\s+of\s+{E}\s+is\s+actually\s+{V}",
    r"{A}\s+for\s+{E}\s+(?:is|was|remains)\s+{V}",
    r"with\s+(?:a|an|the)\s+{A}\s+of\s+{V},\s+{E}",
    r"{E}\s*[:\-]\s*{A}\s*(?:=|:)\s*{V}",
    r"{E}\s+(?:is\s+)?characterized\s+by\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"(?:according\s+to\s+)?{E},\s+{A}\s+(?:equals|is|stands\s+at|reaches)\s+{V}",
    r"{E}\s+demonstrates\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"{E}\s+(?:features|includes|contains)\s+(?:a|an|the)\s+{A}\s+of\s+{V}",
    r"(?:a|an|the)\s+{A}\s+of\s+{V}\s+(?:makes|defines|characterizes|distinguishes)\s+{E}",
]

HINTS = [
    [" reports ", " lists ", " states ", " shows ", " notes ", " confirms ", " records ", " specifies "],
    [" confirms "],
    [" release in ", " released in "],
    ["screening status of"],
    ["best metric for"],
    ["'s "],
    [" has ", " of "],
    [" boasts ", " achieves "],
    [" shows ", " operates with ", " experiences ", " has shown ", " recorded with ", " reveals ", " exhibits "],
    [" recorded "],
    [" known for "],
    ["for ", "within "],
    [" of ", " is ", " remains "],
    [" of ", " measured at ", " recorded at ", " reported as "],
    [" for ", " reported as ", " measured at ", " recorded at ", " increased to ", " decreased to "],
    [" has been reported to have ", " reported to have "],
    [" actually "],
    [" for "],
    ["with ", " of ", ","],
    [":", "=", " - "],
]

#: For each pattern, what any match of it must hold; spares long segments a costly search in vain.
NEEDS = [
    "reports|lists|states|shows|notes|confirms|records|indicates|specifies", "confirms", "release", "screening", "best", "'s",
    "has", "boasts|achieves", "shows|operates|experiences|has|reveals|exhibits", "recorded", "known", ",", "of", "of", "for",
    "reported", "actually", "for", "with", "[:=]", "characterized", ",", "demonstrates", "features|includes|contains",
    "makes|defines|characterizes|distinguishes",
]

#: The pattern that is tried on whole documents, case mattering.
GENERIC = r"([A-Z][A-Za-z0-9\-\s]+?)\s+(?:reports|lists|states|shows)\s+([a-zA-Z_][a-zA-Z0-9_\-\s]+?)\s+(?:as|is)\s+([A-Za-z0-9@._%-]+)"

NARRATIVE_PREFIXES = [
    "the", "contrarily", "in reality", "recent tests show that", "however", "overall", "in contrast",
    "recent evaluations indicate that", "latest tests indicate that", "recent evaluations show that",
    "recent tests indicate that", "latest results reveal that", "testing shows that", "testing of",
    "new benchmarks show that", "in fact", "contrary to popular belief", "on the other hand",
    "it has been reported that", "the latest results indicate that", "the latest tests indicate that",
    "latest results indicate that", "latest updates indicate that", "new data reveals that",
    "some reports indicate that", "reports indicate that", "recent updates indicate that", "despite this",
    "contradicting this", "on the contrary", "in testing", "in tests", "yet",
]

SYNONYMS = {"yes": "true", "no": "false", "enabled": "true", "disabled": "false", "on": "true", "off": "false", "active": "true", "inactive": "false", "approved": "true", "rejected": "false", "pending": "unknown"}
UNITS = ["milliseconds", "millisecond", "seconds", "percent", "second", "bytes", "byte", "ms", "mb", "gb", "tb", "kb", "s", "%"]


def numbered(pattern: str) -> tuple[str, int, int, int]:
    """A pattern as an expression with numbered groups, and the groups of entity, attribute (0: none) and value."""
    order = re.findall(r"\{([EAV])\}", pattern)
    text = pattern.replace("{E}", f"({ENTITY})").replace("{A}", f"({ATTRIBUTE})").replace("{V}", f"({VALUE})")
    place = {name: order.index(name) + 1 if name in order else 0 for name in "EAV"}
    return "(?i)" + text, place["E"], place["A"], place["V"]


#: Patterns that match nothing: their value ends where its segment does, yet more must follow.
NEVER = {i for i, p in enumerate(PATTERNS) if not p.endswith("{V}")}
_LEADS = {"{E}": r"[A-Za-z0-9&/@+.\-\s]", "{A}": r"[A-Za-z0-9_\-\s]"}


def rest(pattern: str) -> tuple[str, str] | None:
    """Of a pattern that begins with an entity or attribute, the places where such a lead can end because all that comes after it
    matches, and the characters of which a lead and the words before it consist. Else None."""
    bare = re.sub(r"^\(\?:(?:the|according\\s\+to)\\s\+\)\?", "", pattern)
    if bare[:3] not in _LEADS:
        return None
    text = bare[3:].replace("{E}", f"(?:{ENTITY})").replace("{A}", f"(?:{ATTRIBUTE})").replace("{V}", f"(?:{VALUE})")
    return rf"(?i)(?<=\S)(?={text})", f"(?i){_LEADS[bare[:3]]}"


#: The same of the generic pattern.
GENERIC_REST = r"(?<=\S)(?=\s+(?:reports|lists|states|shows)\s+[a-zA-Z_][a-zA-Z0-9_\-\s]+?\s+(?:as|is)\s+[A-Za-z0-9@._%-])", r"[A-Za-z0-9\-\s]"
