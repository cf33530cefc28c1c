"""Shared test inputs read from the driver tables (small fixture)."""

SF001 = "/root/testdata/sf0.001"


def docs_sample(spark, n=40):
    d = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(n)
    return [(r.doc_id, r.text) for r in d.collect()]
