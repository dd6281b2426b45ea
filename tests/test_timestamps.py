from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.operators.timestamps import with_utc_micros

UTC = timezone.utc


def us(*args):
    return int((datetime(*args, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, tz string, df boolean")
    return [r.utc_us for r in with_utc_micros(df, "v", "tz", "df").orderBy("i").collect()]


CASES = [
    ("2020-03-04T05:06:07Z", None, None, us(2020, 3, 4, 5, 6, 7)),
    ("2020-03-04t05:06:07,25z", None, None, us(2020, 3, 4, 5, 6, 7, 250000)),
    ("2020-03-04 05:06:07.123456789 +0530", None, None, us(2020, 3, 3, 23, 36, 7, 123456)),
    ("  2020-03-04 05:06  -04:00 ", None, None, us(2020, 3, 4, 9, 6)),
    ("2020-07-04T05:06:07+02:00[Europe/Berlin]", "UTC", None, us(2020, 7, 4, 3, 6, 7)),
    ("2020-07-04 05:06:07 EDT", None, None, us(2020, 7, 4, 9, 6, 7)),
    ("2020-07-04 05:06:07", "America/New_York", False, us(2020, 7, 4, 9, 6, 7)),
    ("03/04/2020 05:06", "UTC", False, us(2020, 3, 4, 5, 6)),
    ("03/04/2020 05:06", "UTC", True, us(2020, 4, 3, 5, 6)),
    ("13.04.2020 05:06", "UTC", True, us(2020, 4, 13, 5, 6)),
    ("13.04.2020 05:06", "UTC", False, None),
    ("03/01/2022 12:19 AM", "UTC", False, us(2022, 3, 1, 0, 19)),
    ("03/01/2022 12:19 PM", "UTC", False, us(2022, 3, 1, 12, 19)),
    ("Sat, 12 Apr 2025 02:56:52 +0530", None, None, us(2025, 4, 11, 21, 26, 52)),
    ("2 Nov 2018 18:39:25", "UTC", None, us(2018, 11, 2, 18, 39, 25)),
    ("Dec 5, 2018 01:58:31 UTC", None, None, us(2018, 12, 5, 1, 58, 31)),
    ("Wed Mar  4 05:06:07 UTC 2020", None, None, us(2020, 3, 4, 5, 6, 7)),
    ("20160804T162624Z", None, None, us(2016, 8, 4, 16, 26, 24)),
    ("1613111404", None, None, 1613111404 * 10**6),
    ("1714422626123", None, None, 1714422626123 * 10**3),
    # a wall-clock time that occurs twice is its first occurrence, one that never occurs is none
    ("2020-10-25 02:30:00", "Europe/Berlin", True, us(2020, 10, 25, 0, 30)),
    ("2020-11-01 01:30:00", "America/New_York", False, us(2020, 11, 1, 5, 30)),
    ("2020-03-29 02:30:00", "Europe/Berlin", True, None),
    # no cases
    ("2020-03-04", "UTC", True, None), ("2020-06", "UTC", True, None), ("2021-02-30T10:00:00Z", None, None, None), ("2021-02-28T24:00:00Z", None, None, None),
    ("2021-02-28T10:61:00Z", None, None, None), ("never", "UTC", True, None), ("", "UTC", True, None), (None, "UTC", True, None), ("0000-00-00T00:00:00", "UTC", None, None),
    ("2020-03-04 05:06:07", None, None, None), ("2020-03-04 05:06:07", "Nowhere/Land", None, None), ("20200304", "UTC", None, None),
]


def test_formats(spark):
    assert run(spark, [c[:3] for c in CASES]) == [c[3] for c in CASES]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1950, 1, 1), datetime(2080, 1, 1)), min_size=30, max_size=30))
def test_wall_clocks_agree_with_zoneinfo(spark, times):
    zone = ZoneInfo("Australia/Sydney")
    rows, want = [], []
    for t in times:
        rows.append((t.isoformat(sep=" ", timespec="microseconds"), "Australia/Sydney", True))
        local = t.replace(tzinfo=zone)  # fold=0: the first occurrence
        back = local.astimezone(UTC).astimezone(zone).replace(tzinfo=None)
        want.append(int((local.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) if back == t else None)
    assert run(spark, rows) == want


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "v string, tz string, df boolean, utc string")
    one = spark.createDataFrame([("2020-03-04T05:06:07Z", None, None, "old")], "v string, tz string, df boolean, utc_us string")
    assert with_utc_micros(one, "v", "tz", "df").first().utc_us == us(2020, 3, 4, 5, 6, 7)
    assert with_utc_micros(one, "v", "tz", "df", out="v").first().v == us(2020, 3, 4, 5, 6, 7)
    out = with_utc_micros(df, "v", "tz", "df", out="x")
    assert out.columns == ["v", "tz", "df", "utc", "x"] and out.count() == 0
