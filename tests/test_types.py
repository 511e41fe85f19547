from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import types


# One case or more for each rule of inference: white space around a value doesn't count; a whole number is an integer,
# beyond 32 bits a long, beyond 64 a double; groups of digits make a text; times in all of the forms that are read.
BY_KIND = {
    "integer": ["42", "\t-15", "007 ", "\n2147483647", "-2147483648"],
    "long": ["2147483648", " -9000000000\n", "9223372036854775807"],
    "double": ["2.5", " -0.75\t", ".125", "9223372036854775808", "6.02e23"],
    "boolean": ["true", " FALSE", "True\n"],
    "string": ["12,500", "1,0.5", "4 2", "x1999-05-06T07:08:09Z", "yes", "1.2.3"],
    "timestamp": [
        "1999-05-06", " 1999-05-06T07:08:09 ", "1999-05-06T07:08:09.123Z", "1999-05-06T07:08:09+02:00", "1999/5/6 07:08", "5/6/1999", "\t5/6/99", "25/12/1999 07:08:09", "12/25/1999 07:08:09",
        "6-May-1999", "6-May-1999 07:08:09", "Thursday, 06-May-99 07:08:09 GMT", "6 May 1999 07:08:09 GMT", "05/06/99 7:8 AM, PDT", "1999年5月6日", "1999年5月6日 07:08",
    ],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in BY_KIND.items() for t in texts])
def test_inference_and_parsing_agree(spark, kind, text):
    assert types.infer(text) == kind
    if kind == "timestamp":
        value = spark.createDataFrame([(text,)], "t string").select(types.parse_timestamp(F.col("t"))).first()[0]
        assert isinstance(value, datetime)


def test_columns_widen_and_never_narrow():
    columns = {
        "integer": ["8", None, " -3", "0"], "long": ["8", "8000000000", "-1", None], "double": ["8", "8000000000", "0.5", "-2"], "string": ["8", "eight", "8", None],
        "timestamp": ["1999-05-06", None, "5/6/1999", "1999-05-06T07:08:09Z"], "boolean": ["true", "FALSE ", None, "1"],
    }
    rows = list(zip(*columns.values(), strict=True))
    assert types.infer_columns(rows, len(columns)) == list(columns)
    assert types.infer_columns([*rows, ("x",) * len(columns)], len(columns)) == ["string"] * len(columns)


def test_parsed_moments(spark):
    texts = ["5/6/1999", "25/12/1999 07:08:09", "1999-05-06T07:08:09+02:00", "6-May-1999", "1999年5月6日", "1999-5-6 7:8:9", "05/06/99 7:8 PM, PDT", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(types.parse_timestamp(F.col("t"))).collect()]
    assert got == [datetime(1999, 5, 6), datetime(1999, 12, 25, 7, 8, 9), datetime(1999, 5, 6, 5, 8, 9), datetime(1999, 5, 6), datetime(1999, 5, 6), datetime(1999, 5, 6, 7, 8, 9), datetime(1999, 5, 6, 19, 8), None]


def test_casts(spark, op):
    df = spark.sql("SELECT '1,234' a, '12abc' b, '3.9' c, 5000000000L d, 0 e, true f, TIMESTAMP '2020-01-02 03:04:05.5' g, 'TRUE' h")
    to = {"a": "integer", "b": "integer", "c": "long", "d": "integer", "e": "boolean", "f": "double", "g": "string", "h": "boolean"}
    got = op("TypeCasting", df, typeCastingUnits=[{"attribute": k, "resultType": v} for k, v in to.items()]).first()
    assert tuple(got) == (1234, 12, 3, 705032704, False, 1.0, "2020-01-02 03:04:05.5", True)
    back = op("TypeCasting", df.select("g", "d"), typeCastingUnits=[{"attribute": "g", "resultType": "long"}, {"attribute": "d", "resultType": "timestamp"}]).first()
    assert back[0] == 1577934245500
    with pytest.raises(Exception, match="can't cast"):
        op("TypeCasting", df, typeCastingUnits=[{"attribute": "g", "resultType": "double"}]).collect()
