from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import zones
from cairn.operators import timestamps


def us(*args, tz=timezone.utc):
    return round((datetime(*args, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


@pytest.mark.parametrize(
    "value, zone, expected",
    [
        ("2024-03-10 02:11:43", "America/New_York", us(2024, 3, 10, 7, 11, 43)),  # skipped: offset before the change
        ("2025-11-02T01:15:28.679505 America/New_York", None, us(2025, 11, 2, 5, 15, 28, 679505)),  # twice: the first
        ("2025-11-02 01:15:28", "America/New_York", us(2025, 11, 2, 5, 15, 28)),
        ("04/23/2026 03:49:59 AM", "Europe/Berlin", us(2026, 4, 23, 1, 49, 59)),
        ("12/31/2025 12:00:00 AM", None, us(2025, 12, 31)),
        ("17.02.2024 05:50:02", "Asia/Tokyo", us(2024, 2, 16, 20, 50, 2)),
        ("2024/02/14 22:19", "Asia/Kolkata", us(2024, 2, 14, 16, 49)),
        ("1741508598.958", "Asia/Tokyo", 1741508598958000),
        ("1728621513", None, 1728621513000000),
        ("1716209949748", None, 1716209949748000),
        ("1724896045908680", None, 1724896045908680),
        ('{"$date":{"$numberLong":"1714599736346"}}', None, 1714599736346000),
        ("2025-05-19T11:01:06.436728120Z", None, us(2025, 5, 19, 11, 1, 6, 436728)),
        ("2025-10-06T23:31:34+0900", None, us(2025, 10, 6, 14, 31, 34)),
        ("2024-02-19 22:16:30.218465+00", None, us(2024, 2, 19, 22, 16, 30, 218465)),
        ("2025-08-29 20:32:37.313548z", None, us(2025, 8, 29, 20, 32, 37, 313548)),
        ("Wed, 14 May 2025 07:35:09 +0530", None, us(2025, 5, 14, 2, 5, 9)),
        ("Oct 25, 2025, 8:59:51 AM PDT", None, us(2025, 10, 25, 15, 59, 51)),
        ("Feb 16, 2026, 4:55:24 PM GMT", None, us(2026, 2, 16, 16, 55, 24)),
        ("2026-01-10T12:29:53.320543[Asia/Tokyo]", "UTC", us(2026, 1, 10, 3, 29, 53, 320543)),
        ("2025-13-40", None, None),
        ("2025-02-29 10:00:00", None, None),
        ("0000-00-00T00:00:00", None, None),
        ("25:00", None, None),
        ("yesterday", None, None),
        ("n/a", None, None),
        ("", None, None),
        (" ", None, None),
        (None, "UTC", None),
        ("2024-01-01 00:00:00 Nowhere/Land", None, None),
        ("2024-01-01 00:00:00", "Nowhere/Land", us(2024, 1, 1)),
    ],
)
def test_notations(value, zone, expected):
    assert timestamps.parse_batch([value], [zone]) == [expected]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Pacific/Apia"]), st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)))
def test_transition_tables_agree_with_the_database(zone, local):
    z = ZoneInfo(zone)
    first = local.replace(tzinfo=z, fold=0)
    expected = round((first.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    flat = round((local - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert zones.local_to_utc(np.array([flat]), zone)[0] == expected


def test_normalise_keeps_columns_and_handles_empty_tables(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", None, 7), (None, "UTC", 8), ("01.02.2024", "UTC", None)], "v string, z string, utc_us long")
    out = timestamps.normalise(df, "v", "z")
    assert out.columns == ["v", "z", "utc_us"]
    assert [r.utc_us for r in out.collect()] == [us(2024, 1, 1), None, us(2024, 2, 1)]
    assert timestamps.normalise(df.limit(0), "v").count() == 0


def test_machine_notations_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("2024-05-01T21:42:17.295222+00:00",), ('{"$date":{"$numberLong":"1770050308865"}}',), ("n/a",), (None,)], "v string")
    assert [r[0] for r in df.select(timestamps.instant(df.v)).collect()] == [us(2024, 5, 1, 21, 42, 17, 295222), 1770050308865000, None, None]
