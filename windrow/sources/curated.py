"""Events of the province that are known by hand, beside those that are fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id string, kind string, analysis_mode string, name string, start timestamp, end timestamp, lat double, lng double, radius_km double, source string, confidence double, hotspot_count long, reference_url string"
# fixed values: the events that every dataset of the province has
EVENTS = (
    ("inegol-osb-fabrika-yangini-2023-08-01", "industrial-fire", "spatial", "İnegöl OSB fabrika yangını", "2023-08-01T15:30:00Z", "2023-08-02T23:59:59Z", 40.0876, 29.514, 8.0, "Anadolu Ajansı", 0.86, 1, "https://www.aa.com.tr/tr/gundem/bursadaki-fabrika-yangininda-10-fabrika-hasar-gordu/2959911"),
    ("kuzey-afrika-toz-tasinimi-2024-04-24", "dust-transport", "temporal", "Kuzey Afrika toz taşınımı", "2024-04-24T00:00:00Z", "2024-04-26T23:59:59Z", 40.195, 29.06, 55.0, "Anadolu Ajansı", 0.74, 0, "https://www.aa.com.tr/tr/yasam/meteorolojiden-kuzey-afrika-kaynakli-toz-tasinimi-uyarisi/3200922"),
    ("lodos-ve-toz-savrulmasi-2024-06-14", "wind-event", "temporal", "Lodos ve toz savrulması", "2024-06-14T12:00:00Z", "2024-06-14T22:00:00Z", 40.195, 29.06, 50.0, "Bursa Valiliği", 0.78, 0, "https://www.bursa.gov.tr/meteorolojik-uyari-2024-25"),
    ("nilufer-yolcati-orman-yangini-2024-06-30", "fire", "spatial", "Nilüfer Yolçatı orman yangını", "2024-06-30T14:26:00Z", "2024-07-01T12:00:00Z", 40.214, 28.878, 10.0, "Bursa Büyükşehir Belediyesi İtfaiye", 0.82, 1, "https://itfaiye.bursa.bel.tr/1440/Niluferde_orman_yangini.html"),
    ("yenisehir-kavakli-yangini-2025-08-01", "fire", "spatial", "Yenişehir Kavaklı yangını", "2025-08-01T13:55:00Z", "2025-08-02T12:00:00Z", 40.271, 29.6, 12.0, "Bursa Valiliği", 0.8, 1, "https://www.bursa.gov.tr/yenisehir-kavakli-mahallesi-civarinda-cikan-yangin-kontrol-altina-alindi"),
    ("gursu-kestel-orman-yangini-2025-07-26", "fire", "spatial", "Gürsu-Kestel orman yangını", "2025-07-26T12:00:00Z", "2025-07-27T23:59:59Z", 40.222, 29.208, 14.0, "Anadolu Ajansı", 0.88, 1, "https://www.aa.com.tr/tr/gundem/bursadaki-orman-yangininda-zarar-goren-kirsal-mahallelerde-hasarin-boyutu-gunun-agarmasiyla-ortaya-cikti/3643216"),
)


def events(spark: SparkSession, start: str | None = None, end: str | None = None) -> DataFrame:
    """The known events that touch a range of days (all without one), with start_day and end_day."""
    raw = spark.createDataFrame(EVENTS, SCHEMA.replace("timestamp", "string"))
    out = raw.withColumns({c: F.to_timestamp(c) for c in ("start", "end")}).withColumns({"start_day": F.to_date("start"), "end_day": F.to_date("end")})
    if start:
        out = out.where(F.col("end_day") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("start_day") <= F.lit(end).cast("date"))
    return out
