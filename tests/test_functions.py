"""Hex decoding (C1, C2) and small scalars."""

from pyspark.sql import functions as F

from txgraph.functions import hex_quantity, hex_to_long, long_to_hex, pairs, strip_0x

MAX = 9223372036854775807

# (payload text, expected value)
CASES = [
    ("0x0", 0), ("0xff", 255), ("0x7fffffffffffffff", MAX), ("0x8000000000000000", MAX),
    ("0x", MAX), ("0xzz", MAX), ("0x 10 ", 16), ("0x0000000000000000000a", 10),
    ("0x-ff", -255), ("0xffffffffffffffffff", MAX), ("0x-8000000000000000", -MAX - 1),
    ("0xFF", 255), ("0x+1f", 31),
]


def test_hex_quantity(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    got = dict(df.select("t", hex_quantity("t").alias("v")).collect())
    assert got == dict(CASES)


def test_hex_null_and_strip(spark):
    df = spark.createDataFrame([(None,), ("x",), ("0xab",)], "t string")
    rows = df.select(hex_quantity("t").alias("v"), strip_0x("t").alias("s")).collect()
    assert rows[0].v is None
    assert rows[1].s == ""
    assert rows[2].s == "ab"


def test_long_to_hex_and_pairs(spark):
    df = spark.range(0, 5)
    rows = df.select(long_to_hex(F.col("id") * 255).alias("h"), pairs("id").alias("p")).collect()
    assert [r.h for r in rows] == ["0x0", "0xff", "0x1fe", "0x2fd", "0x3fc"]
    assert [r.p for r in rows] == [0, 0, 1, 3, 6]


def test_pairs_are_exact_for_large_counts(spark):
    big = [200000003, 1000000007, 4000000000, 2, 1, 0]
    rows = spark.createDataFrame([(n,) for n in big], "n bigint").select("n", pairs("n").alias("p")).collect()
    assert {r.n: r.p for r in rows} == {n: n * (n - 1) // 2 for n in big}


def test_square_is_exact(spark):
    from txgraph.functions.scalars import square

    row = spark.createDataFrame([(3037000507,)], "n bigint").select(square("n").alias("s")).first()
    assert int(row.s) == 3037000507 ** 2


def test_total_of_odd_large_sum_is_exact(spark):
    from txgraph.operators.triangles import triangle_total

    t = 3 * (2 ** 60 + 1)
    tpv = spark.createDataFrame([(1, t - 5), (2, 5)], "id bigint, t bigint")
    assert triangle_total(None, tpv).first()[0] == 2 ** 60 + 1


def test_hex_text_is_looked_at_once(spark):
    """No regular expressions, and the text is trimmed once a value, not once a mention."""
    df = spark.createDataFrame([("0xff",)], "t string").select(hex_quantity("t").alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan
    assert plan.count("trim(both") + plan.count("btrim(") <= 1


def test_hex_odd_text(spark):
    cases = {"\x00 \x1fff\t": 255, "+-1": MAX, "- 1": MAX, "é": MAX, "１": MAX, " 1": MAX, "-0": 0, "0" * 40: 0,
             "+": MAX, "": MAX, "0" * 30 + "8000000000000000": MAX, "-08000000000000000": -MAX - 1,
             "-8000000000000001": MAX, "fffffffffffffff": 0xfffffffffffffff}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", hex_to_long("t").alias("v")).collect()) == cases
