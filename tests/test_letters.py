"""Letters beyond ASCII and odd line ends, against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as E

TEXTS = [None, "", "acgt", "Straße", "ACGTß", "strafſe", "Dıe", "ﬁle", "ACGT\x0bACGT", "ACGT\u0085", "ACGT ", "acgt\r\n\f\tN", "abc\n", "abc\x0b", "ŉew", "ACGT" * 3 + "ß" * 7, "ACGT" * 2 + "ſ" * 9, "ACGTKK"]


def both(spark, tmp_path, name):
    rows = spark.createDataFrame([(i, "de", t) for i, t in enumerate(TEXTS)], "doc_id long, lang string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return sorted(tuple(r) for r in E.queries()[name](spark, str(tmp_path)).collect()), sorted(con.sql(E.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["alphabet_class", "sequence_vote"])
def test_letters_beyond_ascii(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name)
    assert got == want
