"""What the pipeline's stages leave in the memory of executors and their Python workers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import packing, quality_classifier
from rankloom.llm.encode import Encoder
from rankloom.llm.queries import tokenizer_file

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unlimited(spark):
    """The session as it begins."""
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def test_encoder_fills_its_memory_and_no_more():
    texts = [" ".join(f"w{i}x{j}" for j in range(50)).strip() for i in range(40)]
    library = Tokenizer.from_file(tokenizer_file())
    encoder = Encoder(tokenizer_file(), 300)
    for _ in range(2):
        for some in (texts[:4], texts[4:]):
            want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
            assert [x.tobytes() for x in encoder.encode(pa.array(some))] == want
        assert len(encoder.memory) == 300


@pytest.mark.parametrize("stage", ["quality_classifier", "quality_rules", "simhash_near_dedup", "mixing", "packing"])
def test_stages_hand_on_small_batches(unlimited, sf, stage):
    spark = unlimited
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(3), sf)
    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 20_000_000 and max(found) < 4_000_000


def test_a_smaller_limit_of_the_session_stays(unlimited, sf):
    unlimited.conf.set(LIMIT, "1m")
    corpus_pipeline.mix(unlimited, unlimited.read.parquet(f"{sf}/documents.parquet"), sf)
    assert unlimited.conf.get(LIMIT) == "1m"


def test_small_batches_and_memory_change_no_piece(unlimited, sf):
    docs = unlimited.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, packing.pack(docs, tokenizer_file()).collect()))
    unlimited.conf.set(LIMIT, "20000")
    assert sorted(map(tuple, packing.pack(docs, tokenizer_file(), remembered=100).collect())) == want


def test_packing_leaves_no_encoder_in_workers(spark, sf):
    def held(batches):
        from rankloom.llm import encode

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(encode._ENCODERS)])], ["n"])

    packing.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(4), tokenizer_file()).collect()
    assert sum(r.n for r in spark.range(0, 4, 1, 4).mapInArrow(held, "n long").collect()) == 0


def test_classifier_fetches_rows_without_other_workers(spark):
    """A frame made of a list of rows runs Python workers of another kind beside those of the stages."""
    staged = spark.range(5).select("id", *[F.lit(b"ab").alias(n) for n in quality_classifier.FEATURES.names])
    made = []
    create = type(spark).createDataFrame

    class Watched:
        def __getattr__(self, name):
            return getattr(spark, name)

        def createDataFrame(self, *args, **more):  # noqa: N802
            made.append(create(spark, *args, **more))
            return made[-1]

    class Staged:
        sparkSession = Watched()

        def join(self, *args):
            return staged.join(*args)

    assert quality_classifier._fetch(Staged(), [3, 1]) == {i: (b"ab",) * 3 for i in (1, 3)}
    assert "PythonRDD" not in made[0]._jdf.queryExecution().toRdd().toDebugString()
