from pyspark.sql import functions as F

from shelfgraph.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, S.match_key("a", True), a="Éditions  du Seuil!") == "ditions du seuil"
    assert one(spark, S.match_key("a"), a="Éditions  du Seuil!") == "éditions du seuil"
    assert one(spark, S.match_key("a", True), a="Война") == ""
    assert one(spark, S.similarity_ratio("a", "b"), a="Penguin Books", b="Penguin Book") == 62.12
    assert one(spark, S.similarity_ratio("a", "b"), a="b a", b="A b") == 100.0
    assert set(one(spark, S.title_variants("a"), a="Dune: Messiah (Dune #2)")) == {"Dune: Messiah (Dune #2)", "Dune", "Dune: Messiah", "Dune Messiah Dune 2"}
    assert one(spark, S.clean("a"), a=" NaN ") is None and one(spark, S.clean("a"), a=" x ") == "x"
    assert one(spark, S.token_key("a"), a="New-York é") == "newyorké"
    assert one(spark, S.shortened("a", 12), a="one  two three four") == "one two…"
    assert one(spark, S.duration("a"), a=3725) == "01:02:05"
    assert one(spark, S.isbn("a"), a="0-306-40615-X") == "030640615X"
    assert one(spark, S.quoted_tokens("a"), a="['a b' \"c\"]") == ["a b", "c"]


def test_numbers_and_dates(spark):
    assert [one(spark, S.safe_int("a"), a=v) for v in ("2005.0", " 12 ", "x", "")] == [None, 12, None, None]
    assert [one(spark, S.to_year("a"), a=v) for v in ("2005.0", "x", None)] == [2005, None, None]
    t = one(spark, S.statement_time("a"), a="+1965-08-00T00:00:00Z")
    assert (t.text, t.year) == ("1965-08-00", 1965)
    t = one(spark, S.statement_time("a"), a="-0044-03-15")
    assert (t.text, t.year) == (None, None)
    assert str(one(spark, S.ymd_date("y", "m", "d"), y=2001, m=2, d=28)) == "2001-02-28" and one(spark, S.ymd_date("y", "m", "d"), y=2001, m=2, d=30) is None
    assert [one(spark, S.is_english("a"), a=v) for v in ("enm", "fre", "1", "1.0", None, "")] == [True, False, True, True, False, False]


def test_lists(spark):
    assert one(spark, S.split_multi("a"), a=" x; ;y ") == ["x", "y"]
    assert one(spark, S.unique_ignoring_case(F.array(F.lit("Sea"), F.lit("sea "), F.lit(None))), a=1) == ["Sea"]
    assert one(spark, S.parsed_list("a"), a="['a', 'b']") == ["a", "b"] and one(spark, S.parsed_list("a"), a="plain") == ["plain"] and one(spark, S.parsed_list("a"), a="[]") == []
    assert one(spark, S.clean_ids(F.array(F.lit(" a"), F.lit("a"), F.lit(""), F.lit("b"))), a=1) == ["a", "b"]
    assert one(spark, S.json_values("a", "$.x[*].id"), a='{"x": [{"id": "p"}, {"id": "q"}]}') == ["p", "q"]
    assert one(spark, S.unit(F.array(F.lit(3.0), F.lit(4.0))), a=1) == [0.6, 0.8]
