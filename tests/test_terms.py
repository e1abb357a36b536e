"""The BM25 terms against its SQL and a plain count: no threshold of document frequency."""

from wardstream.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_rare_terms_are_there(spark):
    import duckdb

    got = {(r.term, r.df, r.idf) for r in catalogue.QUERIES["bm25_terms"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = set(con.execute(catalogue.ORACLE["bm25_terms"]).fetchall())
    assert {x[:2] for x in got} == {x[:2] for x in want} and min(x[1] for x in got) == 1
    idf = {x[0]: x[2] for x in want}
    assert all(abs(i - idf[t]) < 1e-9 for t, _, i in got)
    print("terms", len(got), "with df >= 20", sum(x[1] >= 20 for x in got))
