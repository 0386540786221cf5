from pyspark.sql import functions as F

from lagwise.functions import text


def test_text_is_cut_around_rare_letters_only(spark):
    one = spark.createDataFrame([("Big™ ﬁsh™",), ("™",), ("漢 ab",), ("",)], "x string")
    assert [r[0] for r in one.select(text.around_rare(F.col("x"))).collect()] == [["Big", "™", " ", "ﬁ", "sh", "™", ""], ["™", ""], ["漢 ab"], [""]]
    assert [r[0] for r in one.select(text.name_key(F.col("x"))).collect()] == ["bigtm fishtm", "tm", "ab", ""]
