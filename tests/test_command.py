"""The command from files to packages that answer a request."""

import json
import math
import random
from datetime import date, timedelta

from windrow.__main__ import main
from windrow.operators import slices
from windrow.sources import dataset


def test_files_to_packages(spark, tmp_path):
    r = random.Random(2)
    at = {f"s{i}": (40 + r.random() * 0.3, 29 + r.random() * 0.3) for i in range(8)}
    lines = ["station_id,pollutant,value,timestamp,unit"]
    for s, (lat, lng) in at.items():
        for d in range(75):
            lines.append(f"{s},PM10,{40 + 20 * math.sin(9 * lat) + r.random():.3f},{date(2024, 1, 1) + timedelta(days=d)}T00:00:00Z,ug/m3")
    (tmp_path / "air.csv").write_text("\n".join(lines))
    (tmp_path / "events.csv").write_text("event_id,event_type,name,start_date,end_date,lat,lng,radius_km\ne1,dust,Dust,2024-02-03,2024-02-05,40.1,29.1,10\n")
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    put("stations.json", [{"id": s, "name": s, "district": "D", "source": "municipal-sensor" if s == "s7" else "official", "lat": lat, "lng": lng} for s, (lat, lng) in at.items()])
    put("roads.json", [{"id": "r", "category": "primary", "coordinates": [[40.0, 29.0], [40.3, 29.3]]}])
    put("industries.json", [{"id": "i", "lat": 40.15, "lng": 29.15}])
    put("greens.json", [{"id": "g", "coordinates": [[40.1, 29.1], [40.12, 29.1], [40.12, 29.12], [40.1, 29.12]]}, {"id": "bad", "coordinates": [[40, 29]]}])
    put("elevations.json", [{"id": f"e{i}", "value": 100.0 * i, "coordinates": [[40 + i / 10, 29], [40.05 + i / 10, 29], [40.05 + i / 10, 29.05], [40 + i / 10, 29.05]]} for i in range(3)])
    layers = [x for n in ("stations", "roads", "industries", "greens", "elevations") for x in (f"--{n}", str(tmp_path / f"{n}.json"))]
    out, packages = str(tmp_path / "out"), str(tmp_path / "packages")
    main([out, "v7", "--air", str(tmp_path / "air.csv"), "--events", str(tmp_path / "events.csv"), *layers, "--end", "2024-02-29", "--packages", packages], spark)
    about, tables = dataset.current(spark, out, ["series", "stations", "roads", "events"])
    assert {r.table: r.n for r in about.collect()} == {"series": 480, "stations": 8, "roads": 1, "industries": 1, "greens": 2, "elevations": 3, "events": 1, "coverage": 1} and tables["series"].count() == 480
    manifest, found = dataset.published_packages(spark, packages, "PM10")
    assert {(m.scope, m.months, m.usable_months, m.events, m.dataset_version, m.coverage_end) for m in manifest.collect()} == {("all", 2, 2, 1, "v7", "2024-02-29"), ("physical", 2, 2, 1, "v7", "2024-02-29")}
    got = slices.resolved(found, slices.Request("2024-01-10", "2024-02-10", scope="all"))
    a = got["answer"].first()
    assert a.slices_used == ["month-2024-01", "month-2024-02"] and a.unsupported_reason is None
    cells = got["cells"].collect()
    assert len(cells) >= 40 and all(c.value is not None and c.nearest_road_m is not None and c.nearest_industry_m is not None for c in cells)
    assert got["risks"].count() == len(cells) and got["drivers"].count() == len(slices.DRIVERS) and got["stations"].count() == 8
    event = slices.resolved(found, slices.Request("2024-01-10", "2024-01-12", slice_id="event-e1"))["answer"].first()
    assert (event.mode, event.days) == ("event", 3)
