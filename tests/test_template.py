"""template_hybrid over more vectors than the tables of test_queries.py hold."""

from sagelode.plans.assembly_queries import QUERIES


def test_vectors_past_ten_thousand_have_a_similarity(spark, tmp_path):
    tables = {
        "documents": spark.range(10_000, 10_040).selectExpr("id AS doc_id", "'alpha. beta' AS text", "'en' AS lang", "'web' AS source"),
        "benchmark": spark.sql("SELECT 0L AS item_id, 'other words' AS text"),
        "embeddings": spark.range(10_040).selectExpr("id AS vec_id", "array(1.0f, 0.0f) AS embedding", "0 AS label"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(r) for r in QUERIES["template_hybrid"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 10_000 + i, 0.4, i + 1) for i in range(15)]
