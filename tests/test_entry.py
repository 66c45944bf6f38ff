import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_documents(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "pages", "counts"]
    assert df.count() == spark.read.parquet(f"{data}/documents.parquet").count()
