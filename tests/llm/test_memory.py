"""What the driver and the executors hold at once is bounded, whatever the session's thresholds."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from barloom.llm import common

BROADCAST, READ = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.parquet.columnarReaderBatchSize"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_steps_broadcast_no_exploded_rows(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    rows = common.materialize(spark.range(60_000).select(F.xxhash64("id").alias("key")), "rows")

    def joined():
        many = rows.select("key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
        return rows.join(many, "key").select("key", "bit")

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (plans.append(planned(joined())), write(self, path)))
    before = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "10MB")
    try:
        assert "BroadcastHashJoin" in planned(joined())
        assert common.materialize(joined(), "joined").count() == 60_000 * 32
        assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]
        assert spark.conf.get(BROADCAST) == "10MB"
        spark.conf.set(BROADCAST, "-1")
        with common.small_broadcasts(spark):
            assert spark.conf.get(BROADCAST) == "-1"
    finally:
        spark.conf.set(BROADCAST, before)


def test_lexical_blocks_are_read_few_at_a_time(spark, monkeypatch):
    from barloom.llm import lexical_search

    seen, write = {}, lexical_search.materialize
    monkeypatch.setattr(lexical_search, "materialize", lambda df, name: (seen.setdefault(name, spark.conf.get(READ)), write(df, name))[1])
    docs = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "word3")], "item_id long, text string")
    before = spark.conf.get(READ)
    assert lexical_search.rank_documents(docs, items).count() == 7
    assert {name for name, rows in seen.items() if int(rows) <= 32} == {"lexical-maxima", "best-documents"}
    assert spark.conf.get(READ) == before
