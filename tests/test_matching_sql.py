"""Queries over texts against their SQL on texts that the given tables lack."""

import duckdb
import pytest

import quorumframe.queries as own

#: Stems with endings, the word itself as long as a stem is cut from, labels that are the whole text, a dotted capital I.
TEXTS = ["the", "The.", "of the", "", None, "licens public", "license pública", "licencia publica", "licenses publicas", "LİCENSE PUBLIC", "apach", "apaches", "public", "General Public License version", "licenSe PUBLİC"]
HITS = {6: "treats", 8: "treats", 9: "treats", 10: "treats", 11: "treats", 13: "treats", 14: "treats"}


@pytest.mark.parametrize("name", ["subject_hits", "theme_of_label"])
def test_odd_texts_give_what_the_sql_says(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    df = own.QUERIES[name](spark, str(tmp_path))
    got = {tuple(r) for r in df.collect()}
    assert got == set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({own.ORACLE_SQL[name]})").fetchall())
    assert dict(got) == HITS if name == "subject_hits" else {(0, 4, "the"), (1, 4, "the"), (14, 5, "public")} <= got
