"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same; a letter is told from it by two comparisons, not by one for each kind of white space.
FAST_SPACE = rf"[\x00-\x20\x7f-\x{{10ffff}}&&{SPACE}]"
#: One token, or a run beyond ASCII: a letter-led word, a run, or a single ASCII character.
TOKEN = r"([a-z][a-z0-9]*|[^\x00-\x7F\x85\p{Z}][^\x00-\x7F]*|[\x00-\x08\x0e-\x1b\x21-\x7f])"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+|{SPACE}*;{SPACE}*"
OUTER = " .,:;()[]{}\"'"


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(text), FAST_SPACE + "+"), "")


def unicode_tokens(text: Column) -> Column:
    """ASCII words, single ASCII digits and marks, and character bigrams of runs beyond ASCII."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)

    def bigrams(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(r"^[^\x00-\x7F]{2}"), pairs).otherwise(F.array(t))

    return F.flatten(F.transform(found, bigrams))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of character n-grams of the stripped, lower-cased text; a shorter text is one gram, an empty one none."""
    s = strip_space(F.lower(text))
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def contains_phrase(query: Column, doc: Column) -> Column:
    """1.0 if the lower-cased document holds the lower-cased query."""
    return F.contains(F.lower(doc), F.lower(query)).cast("double")


def sentences(text: Column) -> Column:
    """Stripped, non-empty segments between sentence ends and semicolons."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip_space), lambda s: s != "")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def query_shape(query: Column) -> dict[str, Column]:
    """Whether a query holds digits or special characters, and its share of capitals."""
    return {
        "has_numbers": query.rlike(r"\p{Nd}").cast("double"),
        "has_special": query.rlike(rf"[^\p{{L}}\p{{N}}\t-\r\x1c-\x20\x85\xa0]").cast("double"),
        "capital_ratio": F.length(F.regexp_replace(query, r"[^\p{Lu}]", "")) / F.greatest(F.length(query), F.lit(1)),
    }


def json_object(text: Column, schema: str) -> Column:
    """The first JSON object in a model's answer: in a fenced block, bare, or amid prose; or written as a literal with single quotes and
    True, False or None for values. Null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(\{.*?\})\s*```", 1)
    amid = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.from_json(F.when(c != "", c), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "true"})
    some = lambda c: F.when(F.to_json(parse(c)) != "{}", parse(c))

    def plain(c: Column) -> Column:
        """With JSON's words where a value stands by itself between its neighbours."""
        for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
            c = F.regexp_replace(c, rf"(?<=[:\[,]\s{{0,20}}){word}(?=\s*[,}}\]])", json_word)
        return c

    return F.coalesce(*[some(c) for c in (text, fenced, amid)], *[some(plain(c)) for c in (fenced, amid)])
