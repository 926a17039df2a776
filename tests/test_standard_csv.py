"""Well-formed CSV by Spark's own reader."""

import pytest
from pyspark.sql import functions as F

from rowlantern.sources import read_csv, read_standard_csv


def test_equals_the_split_reader_on_standard_files(spark, put, tmp_path):
    put("set/a.csv", 'file,seq,"b ""x"""\r\n1,"two\r\nlines, ""quoted""",\r\n , é ,"3"\r\n')
    put("set/b.csv", 'file,seq,"b ""x"""\n' + "".join(f'{i},"{i}\n{i}",z\n' for i in range(50)))
    got = read_standard_csv(spark, str(tmp_path / "set"))
    want = read_csv(spark, str(tmp_path / "set")).where("record_id > 0")
    key = ["file", "record_id", "raw"]
    # CR LF in fields is read as LF.
    want = want.withColumn("raw", F.replace("raw", F.lit("\\r\\n"), F.lit("\\n")))
    assert want.where(F.col("raw").contains("two\\nlines")).count() == 1
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect())
    assert got.where(F.col("text").contains("49")).count() == 1
    plan = got._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan


def test_a_row_of_another_length_ends_the_query(spark, put):
    for row in ("1,2,3", "1"):
        path = put(f"bad{len(row)}.csv", f"a,b\n{row}\n")
        with pytest.raises(Exception):
            read_standard_csv(spark, path).collect()
