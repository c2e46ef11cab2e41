"""A batch of the ledger is parsed once, however many fields the rules look at and however many tables it goes to."""

from __future__ import annotations

from pyspark.sql.readwriter import DataFrameWriter

from ripplenet.plans import ingestion
from ripplenet.streaming import ingest


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    plans = []
    put = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), put(self, *a, **b))[1])
    lines = ingestion.raw_lines(spark, "/root/testdata/sf0.001").limit(400)
    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    ledger.write(lines, 0)
    ledger.write(lines, 1)  # all known by now
    assert len(plans) == 4
    for plan in plans:
        assert 0 < plan.count("from_json") <= plan.count("InMemoryRelation")  # in what is held alone
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    monkeypatch.undo()
    good, bad = ingest.ingest_batch(lines)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ledger.events().drop("batch")) == rows(good)
    assert rows(ledger.rejections().where("batch = 0").drop("batch")) == rows(bad)
    assert ledger.rejections().where("batch = 1").count() == lines.count()
