import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cellforge.llm import common  # noqa: E402


def batches(plan):
    """Batches that the plan's column readers handed over, as Spark counted them."""
    own = [m.get().value() for m in [plan.metrics().get("numInputBatches")] if plan.nodeName() == "ColumnarToRow"]
    return sum(own) + sum(batches(plan.children().apply(i)) for i in range(plan.children().size()))


def test_stages_read_whole_texts_few_rows_at_a_time(spark, tmp_path):
    docs = [(i, f"mail {i}@example.org", "en", "s", 9) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    out = dict(corpus_pipeline.STAGES)["pii"](spark, spark.read.parquet(f"{tmp_path}/d"), "")
    assert len(out.collect()) == 2000
    assert batches(out._jdf.queryExecution().executedPlan()) >= 2000 / common.BATCH_ROWS
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 16)
    common.few_rows(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "16"
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")


def test_near_copies_ask_for_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    real, seen = common.components, []

    def components(edges):
        seen.append(edges._jdf.queryExecution().executedPlan().toString())
        return real(edges)

    monkeypatch.setattr(common, "components", components)
    text = "one text about a river and its many stones "
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, text * 3 + "and clouds"), (4, None)], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert {1, 4} <= {r.doc_id for r in out.collect()} <= {1, 3, 4}
    assert len(seen) == 1 and "InArrow" not in seen[0]
