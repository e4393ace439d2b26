"""Time text of many shapes against pandas, one text at a time."""

import pandas as pd

from hostlens.functions.timefmt import normalize_time_text, parse_time

TEXTS = ["12/08/2017 12:02:11.123", "12/08/2017 12:02:11", "2017-12-08 12:02:11.123456", "2017-12-08 12:02:11", "2017-12-08T12:02:11", "2017-12-08T12:02:11.5Z",
         "2017-12-08 12:02:11+02:00", "2017-12-08T12:02:11-0530", "2017/12/08 1:02", "2017-1-8", "1/8/2017", "25/12/2017 10:00", "12-08-2017 01:02:03", "20171208",
         "20171208 12:02:11", "20171208T12:02:11", "Dec 8 2017 12:02:11", "December 8, 2017 12:02", "8 Dec 2017 12:02:11", "8-Dec-2017", "Fri, 08 Dec 2017 12:02:11 GMT",
         "Fri Dec  8 12:02:11 2017", "12/08/2017 12:02:11 AM", "12/08/2017 12:02:11 PM", "12/08/2017 1:02 pm", "  2017-12-08 12:02:11  ", "2017.12.08 12:02:11",
         "2016-02-29", "2017-12-08 12:02:11.1", "2017-12-08 12:02:11.123456789"]
NONE = ["", "not a time", "2017-02-29", "13/13/2017", "2017-12-08 25:00:00", "2017-12-08 12:61:00", "12/08/2017 13:02 PM", "at 5", "2017", "99999999", "Foo 8 2017"]


def test_shapes_against_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + NONE + [None]], "t string").select("t", parse_time("t").alias("p"))
    got = {r.t: r.p for r in df.collect()}
    for t in TEXTS:
        want = pd.to_datetime(t.strip(), utc=True).tz_localize(None).floor("s").to_pydatetime()
        assert got[t] == want, t
    assert all(got[t] is None for t in [*NONE, None])


def test_device_clock_and_given_formats(spark):
    df = spark.createDataFrame([("09:34:33.123 UTC Fri May 11 2018", "2018|05|11")], "a string, b string")
    r = df.select(normalize_time_text("a").alias("a"), normalize_time_text("b", ["yyyy|MM|dd"]).alias("b"), normalize_time_text("b").alias("c")).first()
    assert tuple(r) == ("05/11/2018 09:34:33", "05/11/2018 00:00:00", "2018|05|11")
