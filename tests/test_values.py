import random

from pyspark.sql import functions as F

from lakeingest.functions import files as ff
from lakeingest.functions.values import coordinate_value, id_text, type_of_column


def test_coordinates(spark):
    cases = [("-23.55052", -23.55052), ("-23,5467", -23.5467), ("  -22.9068  ", -22.9068), (None, None), ("", None),
             ("-43,2000 ", -43.2), ("invalido", None), ("1.0d", None), ("1,2,3", None), ("\t7 ", 7.0)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    assert [r[1] for r in df.select("i", coordinate_value(F.col("c"))).orderBy("i").collect()] == [e for _, e in cases]


def test_id_text_is_exact(spark):
    rng = random.Random(1)
    values = [1234567890.0, 1001000.0, 10.5, 0.0, -3.0, 1e-7, 12345678.25, None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[1] for r in df.select("i", id_text(F.col("v"))).orderBy("i").collect()]
    assert got[:5] == ["1234567890", "1001000", "10.5", "0", "-3"] and got[7] is None
    for text, v in zip(got, values):
        assert v is None or abs(v) < 1e-10 and v != 0 or (float(text) == v and "E" not in text and not text.endswith(".0"))


def test_type_rule(spark):
    cols = {"a": (["1", None, "+2"], "bigint"), "b": (["1", "2.5", None], "double"), "c": (["true", "FALSE", None], "boolean"),
            "d": (["1", "x", None], "string"), "e": ([None, None, None], "void"), "f": (["1", "true", None], "string"),
            "g": (["12345678901234567890", "1", None], "double"), "h": (["2024-01-01", None, None], "string")}
    df = spark.createDataFrame(list(zip(*[v for v, _ in cols.values()])), ", ".join(f"{k} string" for k in cols))
    row = df.agg(*[type_of_column(F.col(k)).alias(k) for k in cols]).first()
    assert row.asDict() == {k: t for k, (_, t) in cols.items()}


def test_encoding_classes(spark):
    euro = "é€".encode("cp1252")
    cases = [(b"abc", "utf-8-sig"), (b"\xef\xbb\xbfabc", "utf-8-sig"), ("é€".encode(), "utf-8-sig"), (euro, "cp1252"),
             (b"\xe9\x81", "latin-1"), (b"a" * (ff.HEAD_BYTES - 1) + b"\xc3", "utf-8-sig"), (b"a\xc3", "cp1252")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, c binary")
    got = df.select("i", ff.detect_encoding(F.col("c")).alias("e"), ff.decode_single_byte(F.col("c"), "cp1252").alias("t"))
    got = got.orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in cases]
    assert got[3].t == "é€" and got[4].t == "é�"


def test_delimiters(spark):
    cases = [("a,b;c\n", ","), ("a;b;c,d", ";"), ("abc", ","), ("", ","), ("a\tb\tc", "\t"), ("\ta\t", ","), ("a|b|c;d", "|"),
             ("\n\n" + "a,b\n" * 5 + ";" * 50, ","), ("a;b\r\nc;d\x0be,f", ";")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    assert [r[1] for r in df.select("i", ff.sniff_delimiter(F.col("c"))).orderBy("i").collect()] == [e for _, e in cases]


def test_header_record(spark):
    cases = [("a,b\n1,2", "a,b"), ("\r\n \n\na,\"x\ny\",c\r\n1", 'a,"x\ny",c'), ("so", "so"), ("\ta\tb\n", "\ta\tb")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    assert [r[1] for r in df.select("i", ff.header_record(F.col("c"))).orderBy("i").collect()] == [e for _, e in cases]


def test_formats(spark):
    df = spark.createDataFrame([("/x/a.CSV",), ("/x.csv/a",), ("/x/a.b.Jsonl",), ("/x/a.txt",), ("/x/.csv",)], "p string")
    assert [r[0] for r in df.select(ff.detect_format(F.col("p"))).collect()] == ["csv", None, "jsonl", None, None]
