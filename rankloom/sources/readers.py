"""Readers and writers of the record and benchmark formats, as Spark sources and sinks."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """All files below a folder, through the store's own interface."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped, a malformed line is an error, a missing file has no records."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_records_per_file) if max_records_per_file else writer).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def plain(value: object) -> object:
    """Data classes, models with model_dump, mappings and sequences as what JSON can hold, at any depth."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return plain({f.name: getattr(value, f.name) for f in dataclasses.fields(value)})
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    dump = getattr(value, "model_dump", None)
    return dump() if dump else value


def write_json(path: str | Path, value: object) -> None:
    """Driver-side metadata: sorted keys, ASCII."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str))


def read_json(path: str | Path) -> object:
    return json.loads(Path(path).read_text())


def beir_simple(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels/test.tsv (a header, three columns or more; labels of 0 are kept); a
    document is its text without its title."""
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl", CORPUS).select(F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("doc"))
    queries = read_jsonl(spark, f"{folder}/queries.jsonl", QUERIES).select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return {"corpus": corpus, "queries": queries, "qrels": read_qrels(spark, [f"{folder}/qrels/test.tsv"], keep_zero=True)}


def read_qrels(spark: SparkSession, files: list[str], keep_zero: bool = False) -> DataFrame:
    """Judgements of three (query, document, score) or four (query, run, document, score) columns, with or without a
    header, between tabs or white space."""
    if not files:
        return spark.createDataFrame([], "query_id string, doc_id string, rel int")
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(files).select(parts.alias("p")).filter(F.size("p") >= 3)
    four = F.size("p") >= 4
    rows = rows.select(F.col("p")[0].alias("query_id"), F.when(four, F.col("p")[2]).otherwise(F.col("p")[1]).alias("doc_id"), F.when(four, F.col("p")[3]).otherwise(F.col("p")[2]).try_cast("int").alias("rel")).filter("rel IS NOT NULL")
    return rows if keep_zero else rows.filter("rel > 0")


def beir_comprehensive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Corpus and queries as JSONL or TSV, found anywhere below the folder; titles go before texts; all judgement files,
    of which only positive labels are kept."""
    files = list_files(spark, folder)
    name = lambda f: f.rsplit("/", 1)[-1]

    def one(stem: str) -> DataFrame:
        jsonl = [f for f in files if name(f) == f"{stem}.jsonl"]
        if jsonl:
            rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(jsonl[:1])
        else:
            tsv = [f for f in files if name(f) == f"{stem}.tsv"]
            if not tsv:
                raise FileNotFoundError(f"{stem}.jsonl or {stem}.tsv below {folder}")
            cells = F.split("value", "\t")
            rows = spark.read.text(tsv[:1]).select(cells.alias("c")).filter(F.size("c") >= 2)
            title = F.when(F.size("c") >= 3, F.col("c")[1]).otherwise(F.lit(""))
            rows = rows.select(F.col("c")[0].alias("_id"), title.alias("title"), F.element_at("c", -1).alias("text")).filter("NOT lower(_id) IN ('_id', 'id', 'query-id', 'corpus-id')")
        both = F.concat_ws(" ", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), F.coalesce("text", F.lit("")))
        return rows.select(F.col("_id").alias("id"), F.trim(both).alias("text"))

    qrels = [f for f in files if "qrels" in f[len(folder.rstrip("/")) :] and name(f).endswith((".tsv", ".txt"))]
    return {"corpus": one("corpus").toDF("doc_id", "doc"), "queries": one("queries").toDF("query_id", "query"), "qrels": read_qrels(spark, qrels)}


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c"))


def trec_covid(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Documents from qrels/collectionandqueries/docs.tsv (id, title, text; both go into the document) or else
    collectionandqueries/collection.tsv (id, text); queries from queries.tsv there; only positive judgements of four
    columns. What isn't there has no rows."""
    docs, plain_docs = f"{folder}/qrels/collectionandqueries/docs.tsv", f"{folder}/collectionandqueries/collection.tsv"
    c = F.col("c")
    if path_exists(spark, docs):
        corpus = _tsv(spark, docs).filter(F.size("c") >= 3).select(c[0].alias("doc_id"), F.concat_ws(" ", c[1], c[2]).alias("doc"))
    elif path_exists(spark, plain_docs):
        corpus = _tsv(spark, plain_docs).filter(F.size("c") >= 2).select(c[0].alias("doc_id"), c[1].alias("doc"))
    else:
        corpus = spark.createDataFrame([], "doc_id string, doc string")
    asked = f"{folder}/collectionandqueries/queries.tsv"
    queries = _tsv(spark, asked).filter(F.size("c") >= 2).select(c[0].alias("query_id"), c[1].alias("query")) if path_exists(spark, asked) else spark.createDataFrame([], "query_id string, query string")
    return {"corpus": corpus, "queries": queries, "qrels": _four_columns(spark, f"{folder}/qrels/test.tsv")}


def _four_columns(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return read_qrels(spark, [])
    rows = _tsv(spark, path).filter(F.size("c") >= 4)
    return rows.select(F.col("c")[0].alias("query_id"), F.col("c")[2].alias("doc_id"), F.col("c")[3].try_cast("int").alias("rel")).filter("rel > 0")


def nfcorpus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nfcorpus/corpus.jsonl (a document is its text), queries of its test and train files, where train's stand for an
    id in both, and only positive judgements of four columns."""
    root = f"{folder}/nfcorpus"
    corpus = read_jsonl(spark, f"{root}/corpus.jsonl", CORPUS).select(F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("doc"))
    sides = [read_jsonl(spark, f"{root}/{s}.queries.jsonl", QUERIES).select("_id", "text", F.lit(i).alias("side")) for i, s in enumerate(("test", "train"))]
    queries = sides[0].unionByName(sides[1]).groupBy(F.col("_id").alias("query_id")).agg(F.max_by("text", "side").alias("query"))
    return {"corpus": corpus, "queries": queries, "qrels": _four_columns(spark, f"{root}/qrels/test.tsv")}


def custom_beir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON file of queries {id: text}, corpus {id: text or {title, text}} and qrels {query: {document: score}}."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "queries map<string,string>, corpus map<string,string>, qrels map<string,map<string,int>>").alias("j")).select("j.*")
    row = whole.select(*[F.col(c).isNull().alias(c) for c in whole.columns], F.size("queries").alias("n_queries"), F.size("corpus").alias("n_corpus")).first()
    missing = [c for c in ("queries", "corpus", "qrels") if row is None or row[c]]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    if row["n_queries"] < 1 or row["n_corpus"] < 1:
        raise ValueError("queries and corpus must not be empty")
    corpus = whole.select(F.explode("corpus").alias("doc_id", "v"))
    given = F.when(F.col("v").startswith("{"), F.from_json("v", "title string, text string"))
    corpus = corpus.select("doc_id", F.coalesce(given["title"], F.lit("")).alias("title"), F.when(given.isNotNull(), F.coalesce(given["text"], F.lit(""))).otherwise(F.col("v")).alias("doc"))
    qrels = whole.select(F.explode("qrels").alias("query_id", "m")).select("query_id", F.explode("m").alias("doc_id", "rel"))
    return {"queries": whole.select(F.explode("queries").alias("query_id", "query")), "corpus": corpus, "qrels": qrels}


def with_prefix(df: DataFrame, column: str, prefix: str = "custom_") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column).cast("string")))


def judged_rows(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements with the texts of query and document; a missing one is empty."""
    rows = qrels.join(queries.select("query_id", "query"), "query_id", "left").join(corpus.select("doc_id", "doc"), "doc_id", "left")
    return rows.fillna("", ["query", "doc"])


def checksum(path: str | Path) -> str:
    """SHA-256 of a local file, in parts."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def unpack(archive: str | Path, folder: str | Path, expected: str | None = None) -> Path:
    """A downloaded archive's files in a folder, if its SHA-256 is the expected one (or none is given) and no entry
    would land outside of the folder; nothing is written otherwise."""
    if expected is not None and checksum(archive) != expected.lower():
        raise ValueError(f"checksum of {archive} is not {expected}")
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        if outside := [n for n in z.namelist() if not (root / n).resolve().is_relative_to(root)]:
            raise ValueError(f"entries outside of the folder: {', '.join(outside)}")
        z.extractall(root)
    return root
