"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A file's parts are its lines, its blocks (runs of lines up to one without a letter or digit, so a wrapped header, or a
paragraph of a licence, is one) and the whole file; each is compared with every template, of which a licence has several
(see license_texts). Words are runs of ASCII letters and digits of the lower-cased text; a word's inverse document
frequency is counted over all files; words in no template share one weight, the mean of the templates' words. Only parts
that could reach the threshold are exploded: one without any of a template's rarer words, which are left when its
commonest words with less than threshold squared of its squared norm are set aside, cannot, nor one whose shared words
have less than that of it, nor one whose own norm, with all its other distinct words counted once, is too great for its
inner product with any template. So the filters lose nothing.

A file declares the licence of its best line or block from PART_COSINE on, or of its whole text from FILE_COSINE on. It is
a licence file if its name says so and it declares a licence, or if its whole text, of FILE_WORDS words or more, reaches
FILE_COSINE, that is if it holds little else. A directory has the licence of its best licence file (then the smallest
path); a file that declares nothing inherits from its nearest ancestor directory that has one. Directories, not files, are
joined with their ancestors; files then get their directory's answer by a counted broadcast, salted beyond its bound, so a
directory with a third of all files stays spread.

Defined cases: a null or empty text declares nothing; a null path lies in no directory and inherits nothing; files with
the same path and text count as one file in their own scan and each keep their row; equal cosines go to the smaller
licence name; without templates nothing is found; an empty table gives no rows. Columns of the input named like an
output are replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, literal_table, materialize, text_key
from .license_texts import TEMPLATES

PART_COSINE = 0.8
FILE_COSINE = 0.9
FILE_WORDS = 20
WORD = "[a-z0-9]+"
#: Lines without a letter or digit, between blocks.
GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"
NAMED = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
#: A text that ends on a line about a licence.
LAST_LINE = r"(?i)licen[sc]e[^\n]*\n*\z"
Templates = dict[str, list[str]]


def tree_path(doc_id: str = "doc_id") -> Column:
    """A path for documents that have none: source, language, and folders of 250 and of 50 ids. A document that ends on a
    notice is its folder of 250's NOTICE file, so the others below inherit from it."""
    noticed = F.coalesce(F.col("text").rlike(LAST_LINE), F.lit(False))
    name = F.concat(F.when(noticed, "NOTICE-").otherwise(""), F.col(doc_id).cast("string"), F.lit(".txt"))
    part = lambda n: F.floor(F.col(doc_id) / n).cast("string")
    return F.concat_ws("/", "source", "lang", part(250), F.when(~noticed, part(50)), name)


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def document_frequencies(files: DataFrame, templates: Templates) -> tuple[int, dict[str, int]]:
    """Files, and for each word of the templates the files that hold it."""
    vocabulary = sorted({w for variants in templates.values() for t in variants for w in words(t)})
    found = F.array_intersect(_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = files.filter("text IS NOT NULL").select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return files.count(), {w: 0 for w in vocabulary} | {r[0]: r[1] for r in counts}


class Weights:
    """Inverse document frequencies, and the templates as unit vectors."""

    def __init__(self, n: int, df: dict[str, int], templates: Templates) -> None:
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.other = sum(self.idf.values()) / max(len(self.idf), 1)
        self.templates: dict[tuple[str, int], dict[str, float]] = {}
        for name, variants in sorted(templates.items()):
            for i, text in enumerate(variants):
                weight = {w: c * self.idf[w] for w, c in Counter(words(text)).items()}
                norm = math.sqrt(sum(x * x for x in weight.values()))
                self.templates[name, i] = {w: x / norm for w, x in weight.items()}

    def needed(self, cosine: float) -> list[str]:
        """Words of which a text must hold one to reach this cosine with some template: those that are left when the
        words in most files, with less than the cosine squared of the template's squared norm, are set aside."""
        out: set[str] = set()
        for weight in self.templates.values():
            left = cosine * cosine * (1 - 1e-9)
            for w, x in sorted(weight.items(), key=lambda p: (self.idf[p[0]], p[0])):
                if x * x < left:
                    left -= x * x
                else:
                    out.add(w)
        return sorted(out)


def _could(part: Column, weights: Weights, cosine: float, own: bool = True) -> Column:
    """Whether the words that a part shares with some template have enough of the template's norm for this cosine, and
    (own) whether the part's other words leave enough of its own."""
    vocabulary = F.array(*map(F.lit, sorted(weights.idf)))
    entries = json.dumps([[{"w": w, "x": x} for w, x in t.items()] for t in weights.templates.values()])
    templates = F.from_json(F.lit(entries), "array<array<struct<w: string, x: double>>>")
    idf = F.from_json(F.lit(json.dumps(weights.idf)), "map<string, double>")
    enough = (cosine - 1e-8) ** 2  # cosines are rounded to nine digits

    needed = F.array(*map(F.lit, weights.needed(cosine)))

    once = lambda value, use: F.exists(F.array(value), use)  # noqa: E731 - value is found once, not at each of its uses
    total = lambda items, of: F.aggregate(items, F.lit(0.0), lambda s, e: s + of(e))

    def near(found: Column, present: Column) -> Column:
        """Whether the part's inner product with some template reaches the cosine at the least norm that it can have."""
        weight = lambda w: F.struct(w.alias("w"), (idf[w] * F.size(F.filter(found, lambda x: x == w))).alias("y"))
        others = F.size(F.array_distinct(found)) - F.size(present)

        def close(mine: Column) -> Column:
            dot = lambda t: total(mine, lambda m: m["y"] * total(F.filter(t, lambda e: e["w"] == m["w"]), lambda e: e["x"]))
            norm = total(mine, lambda m: m["y"] * m["y"]) + others * F.lit(weights.other**2)
            return once(norm, lambda n: F.exists(templates, lambda t: F.pow(dot(t), F.lit(2.0)) >= n * enough))

        return once(F.transform(present, weight), close)

    def reaches(found: Column, present: Column) -> Column:
        shared = lambda t: total(t, lambda e: F.when(F.array_contains(present, e["w"]), e["x"] * e["x"]).otherwise(F.lit(0.0)))
        could = F.arrays_overlap(present, needed) & F.exists(templates, lambda t: shared(t) >= enough)
        return could & near(found, present) if own else could

    return once(_words(part), lambda found: once(F.array_intersect(found, vocabulary), lambda present: reaches(found, present)))


def parts_of(files: DataFrame, weights: Weights, least: float, file_least: float) -> DataFrame:
    """__path, __text, kind ('line', 'block', 'file'), at and part, of parts that could reach least, and of
    whole files that could reach file_least."""
    texts = files.filter("text IS NOT NULL").filter(_could(F.col("text"), weights, least, own=False)).select("__path", F.xxhash64("text").alias("__text"), "text")

    def pieces(kind: str, cut: str) -> DataFrame:
        found = texts.select("__path", "__text", F.lit(kind).alias("kind"), F.posexplode(F.split("text", cut)).alias("at", "part"))
        return found.filter(_could(F.col("part"), weights, least))

    blocks = pieces("block", GAP).filter(F.col("part").contains("\n"))
    whole = texts.filter(_could(F.col("text"), weights, file_least))
    return pieces("line", "\n").unionByName(blocks).unionByName(whole.select("__path", "__text", F.lit("file").alias("kind"), F.lit(0).alias("at"), F.col("text").alias("part")))


def cosines(files: DataFrame, weights: Weights, least: float, file_least: float) -> DataFrame:
    """__path, __text, kind, license, cosine, n_words for parts and files that could reach these, of their best template of each
    licence. The templates' words, a bounded parameter, are broadcast."""
    key = ["__path", "__text", "kind", "at"]
    terms = parts_of(files, weights, least, file_least).select(*key, F.explode(_words(F.col("part"))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    spark = files.sparkSession
    idf = literal_table(spark, sorted(weights.idf.items()), {"word": "string", "idf": "double"})
    entries = [(w, n, i, x) for (n, i), weight in weights.templates.items() for w, x in weight.items()]
    templates = literal_table(spark, entries, {"word": "string", "license": "string", "variant": "int", "x": "double"})
    weighted = materialize(terms.join(F.broadcast(idf), "word", "left").select(*key, "word", "tf", (F.col("tf") * F.coalesce("idf", F.lit(weights.other))).alias("w")), "license-terms")
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_words"))
    dots = weighted.join(F.broadcast(templates), "word").groupBy(*key, "license", "variant").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    best = dots.groupBy(*key, "license").agg(F.max("dot").alias("dot"))
    return best.join(norms, key).select(*key, "license", "n_words", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))


def _best(cosine: str = "cosine") -> Column:
    """The greatest cosine, then the smallest licence name."""
    return F.min(F.struct((-F.col(cosine)).alias("less"), F.col("license")))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def nearest(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """__dir, __inherited: for each folder the licence of its nearest ancestor (itself first) in licensed(__up, license)."""
    parts = F.split("__dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))
    above = folders.select("__dir", F.explode(F.when(F.col("__dir") == "", F.slice(ups, 1, 1)).otherwise(ups)).alias("a")).select("__dir", "a.depth", F.col("a.up").alias("__up"))
    return join_small(above, licensed, "__up", "inner").groupBy("__dir").agg(F.max_by("license", "depth").alias("__inherited"))


def scan(files: DataFrame, templates: Templates = TEMPLATES, part_cosine: float = PART_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """files(path, text, ...) with license, found ('declared', 'inherited' or null) and cosine (of the best part)."""
    files = files.drop("license", "found", "cosine")
    if not templates:
        return files.select("*", F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("double").alias("cosine"))
    keyed = files.withColumn("__path", text_key("path")).withColumn("__text", F.xxhash64("text"))
    weights = Weights(*document_frequencies(files, templates), templates)
    whole = F.col("kind") == "file"
    enough = (~whole & (F.col("cosine") >= part_cosine)) | (whole & (F.col("cosine") >= file_cosine))
    near = materialize(cosines(keyed, weights, min(part_cosine, file_cosine), file_cosine).filter(enough), "license-cosines")
    declared = near.groupBy("__path", "__text").agg(_best().alias("b"))
    declared = materialize(declared.select("__path", "__text", F.col("b.license").alias("__declared"), (-F.col("b.less")).alias("cosine")), "license-declared")
    named = F.substring("__path", 3, 1 << 30).rlike(NAMED)
    sources = near.filter((named | (whole & (F.col("n_words") >= FILE_WORDS))) & F.col("__path").startswith("v:")).withColumn("p", F.substring("__path", 3, 1 << 30))
    licensed = sources.groupBy(_folder(F.col("p")).alias("__up")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("p"), F.col("license"))).alias("b")).select("__up", F.col("b.license").alias("license"))
    folders = keyed.filter("path IS NOT NULL").select(_folder(F.col("path")).alias("__dir")).distinct()
    by_folder = nearest(folders, materialize(licensed, "license-folders"))
    narrow = keyed.join(declared, ["__path", "__text"], "left").withColumn("__dir", _folder(F.col("path")))
    found = join_small(narrow, materialize(by_folder, "license-inherited"), "__dir")
    license = F.coalesce("__declared", "__inherited")
    how = F.when(F.col("__declared").isNotNull(), "declared").when(F.col("__inherited").isNotNull(), "inherited")
    return found.select(*files.columns, license.alias("license"), how.alias("found"), "cosine")


def _oracle() -> str:
    values = ", ".join(f"('{n}', {i}, '{t.lower()}')" for n, variants in TEMPLATES.items() for i, t in enumerate(variants))
    return f"""
WITH t AS (SELECT license, variant, unnest(regexp_extract_all(txt, '{WORD}')) AS word FROM (VALUES {values}) AS x(license, variant, txt)),
ttf AS (SELECT license, variant, word, count(*) AS tf FROM t GROUP BY ALL),
placed AS (SELECT *, coalesce(regexp_matches(text, '{LAST_LINE}'), false) AS noticed FROM documents),
paths AS (SELECT *, concat_ws('/', source, lang, doc_id // 250, CASE WHEN NOT noticed THEN doc_id // 50 END, CASE WHEN noticed THEN 'NOTICE-' ELSE '' END || doc_id || '.txt') AS path FROM placed),
docs AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, text FROM paths),
seen AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM docs),
idf AS (SELECT v.word, ln((1 + (SELECT count(*) FROM docs)) / (1e0 + count(s.doc_id))) + 1 AS idf
  FROM (SELECT DISTINCT word FROM ttf) v LEFT JOIN seen s USING (word) GROUP BY v.word),
other AS (SELECT avg(idf) AS idf FROM idf),
tw AS (SELECT license, variant, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license, variant)) AS w FROM ttf JOIN idf USING (word)),
blocks AS (SELECT doc_id, unnest(string_split_regex(text, '{GAP}')) AS part, unnest(range(len(string_split_regex(text, '{GAP}')))) AS line FROM docs),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS line, 0 AS kind FROM docs
  UNION ALL SELECT doc_id, part, line, 1 FROM blocks WHERE contains(part, chr(10)) UNION ALL SELECT doc_id, text, 0, 2 FROM docs),
lw AS (SELECT doc_id, kind, line, unnest(regexp_extract_all(lower(part), '{WORD}')) AS word FROM lines),
ltf AS (SELECT doc_id, kind, line, word, count(*) AS tf FROM lw GROUP BY ALL),
lv AS (SELECT doc_id, kind, line, word, tf, tf * coalesce(idf.idf, other.idf) AS w FROM ltf LEFT JOIN idf USING (word) CROSS JOIN other),
norms AS (SELECT doc_id, kind, line, sqrt(sum(w * w)) AS norm, sum(tf) AS n_words FROM lv GROUP BY ALL),
cosines AS (SELECT doc_id, kind, line, license, variant, round(sum(lv.w * tw.w) / any_value(norm), 9) AS cosine, any_value(n_words) AS n_words
  FROM lv JOIN tw USING (word) JOIN norms USING (doc_id, kind, line) GROUP BY doc_id, kind, line, license, variant
  HAVING cosine >= CASE WHEN kind = 2 THEN {FILE_COSINE} ELSE {PART_COSINE} END),
declared AS (SELECT doc_id, license, cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS n FROM cosines) WHERE n = 1),
dirs AS (SELECT dir, license FROM (
  SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, license) AS n FROM cosines JOIN docs USING (doc_id)
  WHERE regexp_matches(path, '{NAMED}') OR (kind = 2 AND n_words >= {FILE_WORDS})) WHERE n = 1),
above AS (SELECT DISTINCT dir FROM docs),
nearest AS (SELECT above.dir, max_by(dirs.license, length(dirs.dir)) AS license FROM above JOIN dirs
  ON above.dir = dirs.dir OR starts_with(above.dir, dirs.dir || '/') GROUP BY above.dir)
SELECT doc_id, path, coalesce(d.license, i.license) AS license,
  CASE WHEN d.license IS NOT NULL THEN 'declared' WHEN i.license IS NOT NULL THEN 'inherited' END AS found, d.cosine
FROM docs LEFT JOIN declared d USING (doc_id) LEFT JOIN nearest i USING (dir)
"""


ORACLE_SQL = _oracle()
