import json

from choicerank.sources import tables as sources
from choicerank.sources.schemas import options_schema


def document(*pricings):
    return json.dumps({"data": {"$values": [{"legs": [{"x": 1}], "pricings": list(pricings)}]}}, indent=1)


def test_extract_labels(spark, tmp_path):
    files = {
        "s1": document({"ordinal": 0, "totalPrice": 5.5, "category": "c", "labels": ["BestPrice"]},
                       {"totalPrice": 7.0, "labels": None}),
        "s2": document(),
        "s3": document({"ordinal": 4, "totalPrice": None}),
        "s4": document({"ordinal": 1})[:-40],
        "s5": json.dumps({"data": {}}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "notes.txt").write_text("not a document")
    good, bad = sources.extract_labels(spark, str(tmp_path))
    rows = sorted((r["ranker_id"], r["row_id"], r["totalPrice"], r["category"], r["labels"]) for r in good.collect())
    assert rows == [("s1", 1, 5.5, "c", ["BestPrice"]), ("s1", 1, 7.0, None, []), ("s3", 5, 0.0, None, [])]
    assert [r["ranker_id"] for r in bad.collect()] == ["s4"]

    sources.write_result(good, str(tmp_path / "labels"))
    assert sources.read_labels(spark, str(tmp_path / "labels")).count() == 3


def test_read_airports_by_name(spark, tmp_path):
    path = tmp_path / "airports.csv"
    path.write_text("Country_CodeA2,IATA,GeoPointLat,UTC_Offset_Hours\nRU,SVO,55.9,3.0\n,XXX,,\n")
    rows = [tuple(r) for r in sources.read_airports(spark, str(path)).collect()]
    assert rows == [("SVO", 3.0, "RU"), ("XXX", None, None)]


def test_read_options_drops_the_helper_column(spark, tmp_path):
    path = str(tmp_path / "options")
    spark.createDataFrame([(1, "s", 0)], "Id long, ranker_id string, __index_level_0__ long").write.parquet(path)
    assert sources.read_options(spark, path).columns == ["Id", "ranker_id"]
    assert len(sources.read_options(spark, path, options_schema()).columns) == 126
    assert sources.read_summary(spark, path).count() == 1
