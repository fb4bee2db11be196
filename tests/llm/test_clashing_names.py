"""Columns that are called as the operators' own inner ones."""

from lodestone.llm import minhash, substring


def test_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} end{i % 2}", "a", "b", 1, "c", "d") for i in range(4)] + [(9, "other text", "a", "b", 1, "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_id string, kept_text string, k_root int, row string, n_removed string")
    for out, n in ((minhash.deduplicate(docs), 2), (substring.strip(docs), 5)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == n
        assert all((r.k_id, r.kept_text, r.k_root, r["row"], r.n_removed) == ("a", "b", 1, "c", "d") for r in got)
