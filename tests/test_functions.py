import pytest
from pyspark.sql import functions as F

from sluicegate.functions import headers as H
from tests.conftest import uid


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_header_last(make_records):
    records = make_records([
        {"headers": [("sender", b"a"), ("sender", b"b"), ("other", b"c")]},
        {"headers": []}, {"headers": None}, {"headers": [("sender", None)]},
        {"headers": [("sender", b"a\xff")]}, {"headers": [("sender", b"")]}])
    got = [r[0] for r in records.orderBy("arrival_seq")
           .select(H.header_last(F.col("headers"), "sender")).collect()]
    assert got == ["b", None, None, None, "a�", ""]


def test_parse_epoch_ms(spark):
    texts = ["1000", "-5", "+7", " 1000", "1000 ", "1.0", "", "x", "9223372036854775807",
             "9223372036854775808", "1e3", None]
    assert values(spark, texts, H.parse_epoch_ms) == [
        1000, -5, 7, None, None, None, None, None, 9223372036854775807, None, None, None]


def test_trim_blank(spark):
    texts = ["  a b\t", "\x00\x1fa", " a", " \n ", None]
    assert values(spark, texts, lambda c: H.null_if_empty(H.trim_blank(c))) == [
        "a b", "a", " a", None, None]


@pytest.mark.parametrize("text, want", [
    (uid(1), uid(1)),
    ("ABCDEF01-2345-6789-ABCD-EF0123456789", "abcdef01-2345-6789-abcd-ef0123456789"),
    ("1-2-3-4-5", "00000001-0002-0003-0004-000000000005"),
    ("123456789-12345-1-1-1", "23456789-2345-0001-0001-000000000001"),
    ("+1-2-3-4-5", "00000001-0002-0003-0004-000000000005"),
    ("1-2-3-4-7fffffffffffffff", "00000001-0002-0003-0004-ffffffffffff"),
    ("1-2-3-4-8000000000000000", None),
    ("00000000000000000000000000001-1-1-1-1", None),
    ("invalid-uuid", None), ("1-2-3-4", None), ("1-2-3-4-5-6", None), ("1--3-4-5", None),
    ("g-2-3-4-5", None), ("", None), (None, None)])
def test_uuid_canonical(spark, text, want):
    assert values(spark, [text], H.uuid_canonical) == [want]


def test_key_texts(spark):
    df = spark.createDataFrame([("s", "t", 1, uid(1)), ("s", "t", 1, None)],
                               "s string, t string, p int, m string")
    got = df.select(H.key_text(F.col("s"), F.col("m")),
                    H.sender_partition_text(F.col("s"), F.col("t"), F.col("p"))).collect()
    assert got[0][0] == f"s:{uid(1)}" and got[1][0] is None
    assert got[0][1] == "SenderPartitionKey{sender='s', topic='t', partition=1}"
