from datetime import UTC, datetime

import pandas as pd
import pytest

from partloom.operators.timestamps import local_to_utc, normalise, parser_for, shape_mask, to_utc_frame, transitions, zone_version

US = 1_000_000


def _us(*a, micro=0):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * US + micro


CASES = [
    ("2019-02-20T19:36:38Z", "Europe/Berlin", None, _us(2019, 2, 20, 19, 36, 38)),
    ("2019-02-20T19:36:38", "Europe/Berlin", None, _us(2019, 2, 20, 18, 36, 38)),
    ("2024-08-20T03:04:16+05:30", None, None, _us(2024, 8, 19, 21, 34, 16)),
    ("2015-11-23T22:25:58−05:00", None, None, _us(2015, 11, 24, 3, 25, 58)),
    ("2022-02-06 02:53:21+02", None, None, _us(2022, 2, 6, 0, 53, 21)),
    ("20200502T000104", "UTC", None, _us(2020, 5, 2, 0, 1, 4)),
    ("20230120", "Asia/Tokyo", None, _us(2023, 1, 19, 15)),
    ("2020-10-27 10:59:19.695376764", "UTC", None, _us(2020, 10, 27, 10, 59, 19, micro=695376)),
    ("2017-10-23T13:14:51,233", "UTC", None, _us(2017, 10, 23, 13, 14, 51, micro=233000)),
    ("  2019-03-01  04:50:05 ", "UTC", None, _us(2019, 3, 1, 4, 50, 5)),
    ("1594139949", None, None, 1594139949 * US),
    ("1598012274889", None, None, 1598012274889 * 1000),
    ("1575253727130710", None, None, 1575253727130710),
    ("1624377418.93", None, None, 1624377418 * US + 930000),
    ("/Date(1623037683138)/", None, None, 1623037683138 * 1000),
    ("07/11/2018 20:32:13", "UTC", "dmy", _us(2018, 11, 7, 20, 32, 13)),
    ("07/11/2018 20:32:13", "UTC", "mdy", _us(2018, 7, 11, 20, 32, 13)),
    ("07/11/2018 20:32:13", "UTC", None, None),
    ("15.11.23 12:51", "UTC", "dmy", _us(2023, 11, 15, 12, 51)),
    ("9/19/2016 12:31:26 AM", "UTC", "mdy", _us(2016, 9, 19, 0, 31, 26)),
    ("9/19/2016 13:31:26 PM", "UTC", "mdy", None),
    ("Thu Dec 20 15:57:18 EST 2018", None, None, _us(2018, 12, 20, 20, 57, 18)),
    ("Sun, 26 Feb 2023 22:13:41 +0000", None, None, _us(2023, 2, 26, 22, 13, 41)),
    ("May 19, 2017 1:02 pm", "UTC", None, _us(2017, 5, 19, 13, 2)),
    ("31. Juli 2016, 10:16 Uhr", "Europe/Berlin", None, _us(2016, 7, 31, 8, 16)),
    ("25 de abril de 2018 14:13", "Europe/Madrid", None, _us(2018, 4, 25, 12, 13)),
    ("2023-06-26T19:57:43[Europe/Helsinki]", "UTC", None, _us(2023, 6, 26, 16, 57, 43)),
    ("2023-03-26T02:30:00", "Europe/Berlin", None, None),  # skipped
    ("2023-10-29T02:30:00", "Europe/Berlin", None, None),  # twice
    ("2023-10-29T02:30:00+01:00", "Europe/Berlin", None, _us(2023, 10, 29, 1, 30)),
    ("2023-10-29 02:30:00 CEST", "Europe/Berlin", None, _us(2023, 10, 29, 0, 30)),
    ("2021-13-05 08:00:00", "UTC", None, None),
    ("2019-02-30T10:15:00", "UTC", None, None),
    ("2018-06-17T27:61:00Z", "UTC", None, None),
    ("0000-00-00T00:00:00", "UTC", None, None),
    ("2020-01-01T00:00:00", None, None, None),
    ("2020-01-01T00:00:00", "Mars/Base", None, None),
    ("None", "UTC", None, None), ("-", "UTC", None, None), ("", "UTC", None, None), (" ", "UTC", None, None), (None, "UTC", None, None), ("T14:22:05", "UTC", None, None), ("x" * 5000, "UTC", None, None),
]


@pytest.mark.parametrize(("text", "zone", "order", "want"), CASES)
def test_one_text(text, zone, order, want):
    got = to_utc_frame(pd.Series([text]), pd.Series([zone], dtype=object), pd.Series([order], dtype=object))["utc_us"][0]
    assert (None if pd.isna(got) else int(got)) == want


def test_all_texts_at_once_and_empty():
    t, z, o, want = zip(*CASES, strict=True)
    got = to_utc_frame(pd.Series(t, dtype=object), pd.Series(z, dtype=object), pd.Series(o, dtype=object))["utc_us"]
    assert [None if pd.isna(x) else int(x) for x in got] == list(want)
    assert len(to_utc_frame(pd.Series([], dtype=object), pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


def test_masks_have_one_parser():
    assert shape_mask("Thu Dec 20") == shape_mask("Monday March 31") == "a a 99"
    assert parser_for("9999-99-99") and parser_for("nothing") is None


def test_zone_tables():
    at, offs = transitions("Europe/Berlin")
    assert len(offs) == len(at) + 1 and zone_version()
    import numpy as np

    utc, n = local_to_utc(np.array([0, 1_700_000_000]), "Asia/Kolkata")
    assert list(n) == [1, 1] and list(utc) == [-19_800, 1_700_000_000 - 19_800]


def test_frame_keeps_other_columns(spark):
    rows = [("a", "2020-01-01", "s", 1), ("a", "2020-01-01", "s", 1), ("b", None, None, 2), ("c", "2020-01-01", "unknown", 3)]
    df = spark.createDataFrame(rows, "part_id string, text string, source string, tz_name int")
    sites = spark.createDataFrame([("s", "UTC", None), ("s", "UTC", None), (None, "UTC", None)], "source_dataset string, tz_name string, date_order string")
    out = normalise(df, "text", "source", sites).orderBy("part_id")
    assert out.columns == ["part_id", "text", "source", "tz_name", "instant"]
    assert [r["instant"]["status"] for r in out.collect()] == ["ok", "ok", "none", "zone"]
    assert normalise(df.limit(0), "text", "source", sites).count() == 0
