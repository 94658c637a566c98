from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from stratalog import schemas
from stratalog.operators.detail import landing_sites
from stratalog.sources import corpus, sinks, spreadsheet
from stratalog.sources.catalog import Catalog, country_codes, normalised_components, read_table


def test_json_arrays_lines_and_bundle(spark, tmp_path):
    rows = [{"simulant_id": "S001", "name": "a", "release_date": 1994, "bulk_density": "1.2-1.5"},
            {"simulant_id": "S002", "name": "b", "release_date": "n/a", "bulk_density": 1.5, "specific_gravity": 3}]
    (tmp_path / "simulant.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "data.json").write_text(json.dumps({"simulants": rows, "mineral_groups": [
        {"group_id": "MG001", "simulant_id": "S001", "group_name": "Glass", "value_pct": 0}]}))
    want = [("S001", "1994", "1.2-1.5", None), ("S002", "n/a", "1.5", 3.0)]
    for fmt, name in (("json", "simulant.json"), ("jsonl", "lines.json")):
        df = read_table(spark, str(tmp_path / name), schemas.SIMULANTS, fmt)
        assert [tuple(r) for r in df.select("simulant_id", "release_date", "bulk_density", "specific_gravity").collect()] == want
    bundle = Catalog.load_bundle(spark, str(tmp_path / "data.json"))
    assert bundle.simulants.count() == 2 and bundle.sites.count() == 0 and bundle.sites.schema == schemas.SITES
    assert bundle.mineral_groups.first()["value_pct"] == 0.0


def test_country_codes(spark, tmp_path):
    features = [{"properties": {"ISO_A3": "FRA"}}, {"properties": {"ISO_A3": "-99"}}, {"properties": {"iso_a3": "DEU"}}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = [r["country_code"] for r in country_codes(spark, str(tmp_path / "c.geojson")).collect()]
    assert got == ["FRA", None, "DEU"]


@pytest.mark.parametrize("block", ["16", "97", "1m"])
def test_csv_in_byte_ranges_equals_one_reader(spark, tmp_path, block):
    import csv
    import io
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(int(block.rstrip("m")))
    bits = ["a", "é", "月", "\U0001F600", ",", '"', "\n", "\r\n", " ", "long " * 9]
    want = {}
    for file, ending in (("x", "\n"), ("y", "\r\n")):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["k", 'the "v"\nof it', "w"])
        for k in range(60):
            row = [f"{file}{k}", "<" + "".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) + ">", rnd.choice(["", 'in "the" middle', "z"])]
            writer.writerow(row)
            if k % 9 == 0:
                out.write(ending)
            want[row[0]] = (row[1], row[2] or None)
        (tmp_path / f"{file}.csv").write_bytes(out.getvalue().encode())
    (tmp_path / "y.csv").write_bytes((tmp_path / "y.csv").read_bytes() + b'last,5" pipe,stray "quotes" stay\n')
    want["last"] = ('5" pipe', 'stray "quotes" stay')
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = spreadsheet.read_csv(spark, str(tmp_path), {"k": "k", 'the "v"\nof it': "v", "w": "w", "missing": "m"})
        rows = got.select("k", "v", "w", "m", "ord.file", "ord.row").collect()
        if block == "16":
            assert spark.read.text(str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["k"]: (r["v"], r["w"]) for r in rows} == want and len(rows) == len(want) and all(r["m"] is None for r in rows)
    order = [r["k"] for r in sorted(rows, key=lambda r: (r["file"], r["row"]))]
    assert order == [f"x{k}" for k in range(60)] + [f"y{k}" for k in range(60)] + ["last"]


def test_spreadsheet(spark, tmp_path):
    with open(tmp_path / "s.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["Simulant name ", "Type", "Mineral Composition (Composition;Percentage)"])
        out.writerow([" A-1 ", "", '{"F":\n {"A": 1}}'])
        out.writerow(["", "Mare", ""])
    rows = spreadsheet.read_spreadsheet(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["name"], r["type"], r["mineral_composition_raw"]) for r in rows] == [("A-1", None, '{"F":\n {"A": 1}}')]


def test_drift(spark):
    df = spark.createDataFrame([("S1", "Augite", 5.0)], "simulant_id string, mineral_name string, percentage double")
    assert normalised_components(df, "value_pct").first().asDict() == {"simulant_id": "S1", "component_name": "Augite", "value_pct": 5.0}


def test_html_corpus(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.pdf.html").write_text("<html><script>var x='JSC';</script><p>One &amp; two<br>three</p><style>b</style>" + "<p>text</p>" * 30)
    (pages / "b.html").write_text("<p>short</p>")
    (pages / "c.html:Zone.Identifier.html").write_text("<p>no</p>")
    (pages / "a.pdf metadata.json").write_text("{broken")
    (pages / "a metadata.json").write_text(json.dumps({"title": " Real title "}))
    (tmp_path / "a.pdf").write_text("x")
    files = corpus.html_files(spark, str(pages))
    texts = corpus.corpus_texts(files)
    rows = texts.collect()
    assert [r["file"] for r in rows] == ["a.pdf.html"]
    assert rows[0]["text"].startswith("One & two three text text")
    titled = corpus.with_titles(files, corpus.metadata_files(spark, str(pages)))
    flagged = corpus.with_companion(titled, corpus.file_names(spark, str(tmp_path)))
    got = {r["file"]: (r["title"], r["has_pdf"], r["pdf_filename"]) for r in flagged.collect()}
    assert got == {"a.pdf.html": ("Real title", True, "a.pdf"), "b.html": ("b", False, None)}


def test_upsert_snapshot_and_table(spark, tmp_path, catalog):
    new = spark.createDataFrame([("S001", "new", 1), ("S001", "newer", 2), ("S777", "add", 1)], "simulant_id string, name string, v int")
    old = catalog.simulants.select("simulant_id", "name", F.lit(0).alias("v"))
    got = {r[0]: r[1] for r in sinks.upserted(old, new, ["simulant_id"], [F.col("v")]).collect()}
    assert got["S001"] == "newer" and got["S777"] == "add" and len(got) == 5
    sinks.write_table(catalog.simulants, str(tmp_path / "t"), "simulants")
    assert Catalog.load(spark, {"simulants": str(tmp_path / "t")}).simulants.count() == 4
    path = sinks.snapshot(old, str(tmp_path / "snap"), "1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.snapshot(old, str(tmp_path / "snap"), "1")
    assert spark.read.parquet(path).count() == 4


def test_bundle_export(spark, tmp_path, catalog):
    sinks.write_bundle(catalog, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle/sites")).count() == 2
    lines = [json.loads(x) for f in sorted(glob.glob(str(tmp_path / "bundle/chemical_compositions/*.json"))) for x in open(f)]
    assert [x["composition_id"] for x in lines] == ["CH001", "CH002", "CH003", "CH004", "CH005", "CH006", "CH009", "CH101", "CH1000"]


def test_profile_round_trip(spark, catalog):
    back = sinks.decoded_profiles(sinks.relational_profiles(catalog.lunar_reference))
    assert sorted(back.collect(), key=str) == sorted(catalog.lunar_reference.collect(), key=str)
    blank = spark.createDataFrame([("1", "", None, "", None)], "sample_id string, coordinates string, chemical_composition string, mineral_composition string, sources string")
    row = sinks.decoded_profiles(blank).first()
    assert (row["chemical_composition"], row["mineral_composition"], row["sources"]) == ({}, None, [])


def test_wide_csv(spark, tmp_path, catalog):
    wide = sinks.wide_export(catalog, catalog.simulants)
    sinks.write_csv(wide.coalesce(1), str(tmp_path / "csv"))
    rows = {r["Simulant ID"]: r for r in csv.DictReader(open(glob.glob(str(tmp_path / "csv/*.csv"))[0], newline=""))}
    one = rows["S001"]
    assert one["Notes"] == 'a, "b" c' and one["Mineral: Anorthite (%)"] == "60" and one["Chemical: SiO2 (wt%)"] == "40"
    assert one["Composition Sources"] == "First paper (1999) https://a.org/x. | Tenth" and one["Usage Studies"] == "Second |"
    assert "Chemical: sum (wt%)" not in one and rows["S003"]["Mineral: Augite (%)"] == ""
    own = sinks.entity_export(catalog, "S010")
    assert [c for c in own.columns if ":" in c] == ["Mineral: Augite (%)"]


def test_one_row_of_citations_per_entity_however_many(catalog, monkeypatch):
    whole = sorted(map(tuple, sinks.citation_rollup(catalog.references).collect()))
    monkeypatch.setattr(sinks, "_JOINED_TOGETHER", 1)
    rows = sorted(map(tuple, sinks.citation_rollup(catalog.references).collect()))
    assert rows == whole and [r[0] for r in rows] == ["S001", "S002"]
    assert rows[0][1].startswith("First") and rows[0][1].endswith(" | Tenth")


def test_points_without_coordinates_stay_single(spark):
    from stratalog.operators import cluster

    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.5), (3, None, 1.0), (4, nan, 1.0), (5, 1.0, inf), (6, None, None)]
    points = spark.createDataFrame(rows, "ord bigint, lat double, lon double")
    members = {r["ord"]: r["founder"] for r in cluster.cluster_members(points, 1.0).collect()}
    assert members == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert sorted((r["founder"], r["count"]) for r in cluster.clusters(points, 1.0).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_keys_of_any_length(spark):
    from stratalog.operators.ordering import highest_number

    keys = spark.createDataFrame([("R" + "1" * 19,), ("R" + "9" * 20,), ("R007",), ("X1",), (None,)], "k string")
    assert int(highest_number(keys, "k", "R").first()["highest"]) == int("9" * 20)
    assert int(highest_number(keys, "k", "R.").first()["highest"]) == 0


def test_landing_sites_are_a_source(spark, tmp_path):
    rows = [{"id": "a11", "name": "Apollo 11", "date": "July 20, 1969", "lat": 0.67, "lng": 23.47, "samples_returned": "21.5 kg",
             "type": "Apollo", "geotechnical": {"bulk_density": 1.5}}]
    path = tmp_path / "sites.json"
    path.write_text(json.dumps(rows))
    sites = Catalog.load(spark, {"lunar_sites": str(path)}, "json").lunar_sites
    got = landing_sites(sites).select("id", "lat", "samples_kg", "geotechnical.bulk_density").first()
    assert tuple(got) == ("a11", 0.67, 21.5, 1.5)
