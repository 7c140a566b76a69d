"""Rows of the learners' table: no token sets, and repeated ids count as often as with them."""
from plumbline.plans import models as M


def test_described_has_no_sets(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    rows = [(i, " ".join(words[: 1 + i % 5] * (1 + i % 3)) + f" w{i}", "en" if i % 2 else "de", f"s{i % 4}") for i in range(40)] + [(3, "alpha beta", "en", "s3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain, with_sets = M.described(spark, str(tmp_path)), M.described_sets(spark, str(tmp_path))
    assert "els" not in plain.columns and "els" in with_sets.columns
    count = lambda t: sorted((r.id, r["count"]) for r in t.groupBy("id").count().collect())
    assert count(plain) == count(with_sets) and dict(count(plain))[3] > 1
