"""Workbooks that the test writes come back; two series in one table keep apart."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sunloom.operators import quality, windows
from sunloom.sources.series import dense, from_events
from sunloom.sources.spreadsheet import cells, read_sensor_sheet

COLUMNS = {"ts": "Time", "tsi": "Total solar irradiance (W/m2)", "power": "Power (MW)"}
HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>Power (MW)</t></is></c></row>'


def workbook(rows, strings=("Time", "Total solar irradiance (W/m2)"), from_1904=False, sheets=("Data",)):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><workbookPr date1904="{int(from_1904)}"/><sheets>' + "".join(f'<sheet name="{s}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:3]}</t></r><r><t>{s[3:]}</t></r></si>" for s in strings) + "</sst>")
        for i in range(len(sheets)):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{HEAD}{rows if i == len(sheets) - 1 else ''}</sheetData></worksheet>")
    return out.getvalue()


def row(n, a, b, c):
    return f'<row r="{n}">' + "".join(x.format(f"{k}{n}") for k, x in zip("ABC", (a, b, c), strict=True) if x) + "</row>"


NUM, TEXT = '<c r="{{}}"><v>{}</v></c>'.format, '<c r="{{}}" t="str"><v>{}</v></c>'.format


def test_dates_as_numbers_and_as_text(spark, tmp_path):
    rows = row(2, NUM(43831.25), NUM(1.5), NUM(7)) + row(3, TEXT("2020-01-01 06:15:00"), "", NUM("1e2")) + row(4, "", "", "") + row(5, NUM(43831 + 1 / 96 * 26), '<c r="{}" t="e"><v>#N/A</v></c>', NUM("NaN"))
    (tmp_path / "a.xlsx").write_bytes(workbook(rows, sheets=("Notes", "Data")))
    got = read_sensor_sheet(spark, str(tmp_path / "*.xlsx"), COLUMNS, sheet="Data").orderBy("row_id").collect()
    at = lambda h, m: datetime.datetime(2020, 1, 1, h, m)
    assert [(r["ts"], r["tsi"], r["power"], r["day"], r["series_id"]) for r in got] == [(at(6, 0), 7.0, 1.5, at(0, 0).date(), "all"), (at(6, 15), 100.0, None, at(0, 0).date(), "all"), (at(6, 30), None, None, at(0, 0).date(), "all")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.xlsx").write_bytes(workbook(row(2, NUM(43831.25 - 1462), NUM(1), NUM(1)), from_1904=True))
    assert read_sensor_sheet(spark, str(tmp_path / "b"), COLUMNS).first()["ts"] == at(6, 0)


@pytest.mark.parametrize("rows, said", [(row(2, TEXT("2020-01-01"), NUM(1), NUM(1)), "does not match"), (row(2, NUM(1), TEXT("x"), NUM(1)), "could not convert")])
def test_bad_cells_are_errors(spark, tmp_path, rows, said):
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    with pytest.raises(Exception, match=said):
        read_sensor_sheet(spark, str(tmp_path), COLUMNS).collect()
    with pytest.raises(Exception, match="the header has no Wind"):
        read_sensor_sheet(spark, str(tmp_path), COLUMNS | {"wind": "Wind"}).collect()


def test_many_rows_are_streamed():
    n = 60_000
    content = workbook("".join(row(i + 2, NUM(40000 + i / 96), NUM(i), NUM(0)) for i in range(n)))
    import tracemalloc

    tracemalloc.start()
    count = sum(1 for _ in cells(content))
    assert count == n + 2 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_two_series_keep_apart(spark):
    day = datetime.datetime(2024, 1, 1)
    events = [(day + datetime.timedelta(minutes=15 * i), u, float(i % 7 + 10 * u)) for u in (1, 2) for i in range(0, 96, u)]
    two = from_events(spark.createDataFrame(events, "ts timestamp_ntz, user_id int, value double"), series="user_id")
    for u in (1, 2):
        one = two.where(F.col("series_id") == u).drop("series_id")
        both = lambda df: sorted(map(tuple, df.where(F.col("series_id") == u).drop("series_id").collect()))  # noqa: B023, E731
        flagged = windows.flag_daylight(one, 0.5)
        for f in (dense, quality.ramps_by_day, lambda d: quality.daylight_by_day(windows.flag_daylight(d, 0.5))):
            assert both(f(two)) == sorted(map(tuple, f(one).collect()))
        assert flagged.count() == 96 // u
    cut = windows.candidates(windows.flag_daylight(dense(two), 0.5)).select("series_id", "anchor_ts")
    old = cut.where("series_id = 1")
    assert windows.only_new(cut, old).count() == cut.where("series_id = 2").count() == old.count() == 65
