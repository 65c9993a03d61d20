"""Readers over small files."""

import io
import json
import zipfile
from datetime import date

from windrow.sources import readers


def test_meteo_and_context(spark, tmp_path):
    (tmp_path / "m.csv").write_text('station_id,timestamp,wind_speed,Temperature\nGursu / X,2026-01-01 10:00,"3,5",\n,2026-01-01,1,1\n')
    got = readers.meteo(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.station, r.wind_speed, r.temperature, r.source) for r in got] == [("gursu-x", 3.5, None, "m.csv")]
    (tmp_path / "c.csv").write_text("station_id,road_density,industry_count\na,0.5,2.0\n")
    got = readers.context_metrics(spark, str(tmp_path / "c.csv")).first()
    assert (got.radius_m, got.road_density, got.green_ratio, got.industry_count) == (500, 0.5, 0.0, 2)


def test_events(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_id,start_date,end_date,lat\n,2024-01-01,2024-01-03,40.1\nz,01.02.2024 00:00,02.02.2024 00:00,\n")
    got = readers.events(spark, str(tmp_path / "e.csv")).orderBy("event_id").collect()
    assert [(r.event_id, r.kind, r.name, r.start_day, r.lat, r.radius_km) for r in got] == [("event-1", "fire", "event-1", date(2024, 1, 1), 40.1, 10.0), ("z", "fire", "z", date(2024, 2, 1), 0.0, 10.0)]


def test_map_layers(spark, tmp_path):
    at = lambda *pairs: [{"lat": a, "lon": b} for a, b in pairs]
    square = at((40.0, 29.0), (40.0, 29.01), (40.01, 29.01), (40.01, 29.0))
    elements = [
        {"type": "way", "id": 1, "geometry": at((40, 29), (40, 29.1)), "tags": {"highway": "primary"}},
        {"type": "way", "id": 2, "geometry": square, "tags": {"landuse": "forest"}},
        {"type": "node", "id": 3, "lat": 40.2, "lon": 29.2, "tags": {"man_made": "works"}},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"elements": elements}))
    e = readers.map_elements(spark, str(tmp_path / "m.json"))
    assert {r.id: r.category for r in readers.roads(e).collect()} == {"road-1": "primary", "road-2": "road"}
    green = readers.greens(e, 40.0, 29.0).collect()
    assert [(r.id, r.category) for r in green] == [("green-2", "forest")] and abs(green[0].area - 947_000) < 2_000
    assert {(r.id, r.category, round(r.lat, 3)) for r in readers.industries(e).collect()} == {("industry-way-1", "industrial", 40.0), ("industry-way-2", "forest", 40.005), ("industry-node-3", "works", 40.2)}


def test_workbook(spark, tmp_path):
    cell = lambda at, v: f'<c r="{at}" t="s"><v>{v}</v></c>'
    names = ["device_id", "calculateddatetime", "PM10", "d1"]
    rows = [[cell("A1", 0), cell("B1", 1), cell("C1", 2)], [cell("A2", 3), '<c r="B2"><v>45000.5</v></c>', '<c r="C2"><v>12.5</v></c>']]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{n}</t></si>" for n in names) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    (tmp_path / "w.xlsx").write_bytes(data.getvalue())
    got = readers.sheet_rows(readers.workbook(spark, str(tmp_path / "w.xlsx"))).collect()
    assert {(r.sheet, r.row, r.name, r.value) for r in got} == {("sheet1", 2, "device_id", "d1"), ("sheet1", 2, "calculateddatetime", "45000.5"), ("sheet1", 2, "PM10", "12.5")}
