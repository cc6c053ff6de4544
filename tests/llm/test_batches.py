"""Texts that pass through Python are bounded by bytes, not by rows alone."""

import pyarrow as pa
import pyarrow.parquet as pq

from folioflow.llm import langid, toxicity
from folioflow.llm.common import BATCH_BYTES, ROW_GROUP_BYTES, collected, written

#: A text of a megabyte.
LONG = "repeat('some words ', 95000) || id"


def measured(df):
    """The rows and bytes of each batch."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "size"])

    return df.mapInArrow(sizes, "rows long, size long")


def test_long_texts_come_in_small_batches(spark):
    texts = spark.range(24, numPartitions=1).selectExpr(f"{LONG} as text")
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    for got in (written(measured(texts), "sizes").toArrow(), collected(measured(texts))):
        assert sum(got["rows"].to_pylist()) == 24
        assert max(got["size"].to_pylist()) <= BATCH_BYTES + 2 * (1 << 20)
    assert before == {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in before}


def test_models_are_learned_from_small_batches(spark, monkeypatch):
    docs = spark.range(60, numPartitions=1).selectExpr("id as doc_id", f"{LONG} as text", "'en' as lang")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")

    def watched(run):
        def checked(batches):
            def each():
                for batch in batches:
                    assert batch.nbytes <= 6 << 20
                    yield batch

            return run(each())

        return checked

    counted = toxicity._count_documents
    monkeypatch.setattr(toxicity, "_count_documents", lambda sent: watched(counted(sent)))
    monkeypatch.setattr(langid, "_count_grams", watched(langid._count_grams))
    assert toxicity.fit(docs, labels).index is not None
    assert langid.train(docs).langs == ("en",)


def test_tables_have_small_row_groups(spark):
    texts = spark.range(400, numPartitions=1).selectExpr("transform(sequence(0, 9000), i -> xxhash64(id, i)) as n")
    table = written(texts, "groups")
    (file,) = [f for f in table.inputFiles() if f.endswith(".parquet")]
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert found.num_rows == 400
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) <= 3 * ROW_GROUP_BYTES
