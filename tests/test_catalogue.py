from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import compose, detail, facets, filters, quality
from stratalog.operators.filters import Filter


def ids(df):
    return sorted(r[0] for r in df.select("simulant_id").collect())


def run(catalog, *chosen, **options):
    return ids(filters.apply_filters(catalog, chosen, **options))


ALL = ["S001", "S002", "S003", "S010"]


def test_column_filters(catalog):
    assert run(catalog) == ALL
    assert run(catalog, Filter("type", ())) == ALL
    assert run(catalog, Filter("type", ("Mare", "Highland"))) == ["S001", "S002", "S010"]
    assert run(catalog, Filter("type", ("Mare",)), Filter("availability", ("Available",)), search="ÉA") == ["S001"]
    assert run(catalog, Filter("institution", (filters.NASA_ANY,))) == ["S001", "S002"]
    assert run(catalog, Filter("institution", ("ESA",))) == ["S010"]
    assert run(catalog, Filter("lunar_ref", ("",))) == ["S010"]


def test_bloc_holds_codes_and_names(catalog, spark):
    assert run(catalog, Filter("country", ("EU",))) == ["S001", "S002", "S010"]
    assert run(catalog, Filter("country", ("USA",))) == ["S003"]
    members = spark.createDataFrame([("FRA",)], "country_code string")
    assert run(catalog, Filter("country", ("EU", "USA")), bloc=members) == ["S003", "S010"]


def test_mineral_filter_is_a_disjunction(catalog):
    assert run(catalog, Filter("mineral", ("Augite",))) == ["S010"]
    assert run(catalog, Filter("mineral", ("group:Olivine",))) == ["S002"]
    assert run(catalog, Filter("mineral", ("Augite", "group:Olivine"))) == ["S002", "S010"]
    assert run(catalog, Filter("mineral", ("Augite",)), literal_mineral=True) == ALL
    assert run(catalog, Filter("mineral", ("Augite", "group:Olivine")), literal_mineral=True) == ["S002", "S010"]


def test_child_filters(catalog):
    assert run(catalog, Filter("chemical", ("TiO2", "FeO"))) == ["S001", "S002"]
    assert run(catalog, Filter("chemical", ("TiO2",))) == []
    assert run(catalog, Filter("has_chemistry", ("yes",))) == ["S001", "S002"]
    assert run(catalog, Filter("has_chemistry", ("no",))) == ["S003", "S010"]
    assert run(catalog, Filter("has_mineralogy", ("yes",))) == ["S001", "S002", "S010"]
    assert run(catalog, Filter("reference", ("SECOND",))) == ["S001"]
    assert run(catalog, Filter("reference", ("",))) == ALL


def test_year_filter(catalog):
    assert run(catalog, Filter("year", ("1990", "2000"))) == ["S001"]
    assert run(catalog, Filter("year", ("", "2003"))) == ["S001", "S010"]
    assert run(catalog, Filter("year", ("", ""))) == ["S001", "S010"]


def test_search_is_literal(catalog):
    assert run(catalog, search="e_a") == []
    assert run(catalog, search="esa") == ["S010"]


def test_facets(catalog):
    got = {(r["property"], r["value"]): r["n"] for r in facets.facet_values(catalog).collect()}
    assert got[("institution", filters.NASA_ANY)] == 2
    assert got[("type", None)] == 1 and got[("type", "Mare")] == 2
    assert ("institution", None) not in got and ("chemical", "sum") not in got
    assert got[("group", "Olivine")] == 2


def test_sort_orders(catalog):
    rows = detail.catalogue_table(catalog, catalog.simulants)

    def by(key, descending=False):
        return [r[0] for r in rows.orderBy(*detail.catalogue_order(key, descending)).select("name").collect()]

    assert by("name") == ["alpha", "beta", "Éa-1", "Zeta"]
    assert by("year") == ["Éa-1", "alpha", "beta", "Zeta"]
    assert by("year", True) == ["alpha", "Éa-1", "beta", "Zeta"]
    assert by("reference", True) == ["beta", "Éa-1", "Zeta", "alpha"]
    first = {r["simulant_id"]: r["first_reference"] for r in rows.collect()}
    assert first["S001"].startswith("First paper") and first["S003"] == ""


def test_last_site_wins(catalog):
    got = {r["simulant_id"]: r["site_id"] for r in detail.attach_last(catalog.simulants, catalog.sites, "site_id").collect()}
    assert got == {"S001": "X10", "S002": "X2", "S003": None, "S010": None}
    assert ids(detail.map_points(catalog, catalog.simulants)) == ["S001"]


def test_sourcing_matches_without_case(catalog):
    got = {r["component_name"]: r["sourcing_name"] for r in detail.mineral_sourcing(catalog.compositions, catalog.mineral_sourcing).collect()}
    assert got == {"Anorthite": "anorthite", "Augite": "AUGITE"}
    moved = catalog.compositions.withColumn("mineral_name", F.col("component_name")).withColumn("component_name", F.lit("none"))
    assert detail.mineral_sourcing(moved, catalog.mineral_sourcing, "mineral_name").count() == 3


def test_cards_and_properties(catalog):
    card = {r["simulant_id"]: r for r in detail.entity_cards(catalog, catalog.simulants).collect()}["S001"]
    assert card["petrography"] == "Basalt 60%, Glass 40.5%"
    assert card["sample_reference"] == "10084 / Luna 16" and card["inferred_mission"] == "Apollo 11"
    assert (card["n_chemical"], card["n_mineral"], card["n_reference"]) == (6, 1, 4)
    props = {(r["simulant_id"], r["property"]): r["value"] for r in detail.physical_properties(catalog, catalog.simulants).collect()}
    assert props == {("S001", "bulk_density"): "1.5", ("S001", "specific_gravity"): "2.9", ("S001", "cohesion"): "0.3",
                     ("S001", "grain_size_mm"): "0.1-1"}


def test_citation_cards(catalog):
    got = {r["reference_id"]: r for r in detail.citation_cards(catalog.references).collect()}
    assert (got["R010"]["section"], got["R010"]["number"]) == ("composition", 2)
    assert got["R004"]["section"] == "other" and got["R003"]["section"] == "usage"
    assert got["R003"]["clean_text"] == 'A, (2001), "T",' and got["R003"]["link"] == "https://doi.org/10.1234/z"


def test_first_component_by_length_then_text(catalog):
    got = {(r[0], r[1]): r[2] for r in compose.first_components(catalog.chemical_compositions, "value_wt_pct").collect()}
    assert got[("S001", "SiO2")] == 40.0 and got[("S001", "FeO")] == 8.0


def test_pair_comparison(catalog, spark):
    pairs = spark.createDataFrame([(1, "S001", "S002"), (2, "S003", "S010"), (3, "S001", "S001")], "pair_id int, id_1 string, id_2 string")
    first = compose.first_components(catalog.chemical_compositions, "value_wt_pct")
    got = {(r["pair_id"], r["component_name"]): (r["value_1"], r["value_2"], r["delta"], r["larger"])
           for r in compose.compare_pairs(first, pairs).collect()}
    assert got == {(1, "SiO2"): (40.0, 0.0, 40.0, "first"), (1, "FeO"): (8.0, 12.5, -4.5, "second"),
                   (3, "SiO2"): (40.0, 40.0, 0.0, "tie"), (3, "FeO"): (8.0, 8.0, 0.0, "tie")}
    assert (1, "sum") in {(r["pair_id"], r["component_name"]) for r in compose.compare_pairs(first, pairs, exclude_sum=False).collect()}
    physical = {r["component_name"]: (r["value_1"], r["value_2"]) for r in compose.compare_physical(catalog.simulants, pairs.filter("pair_id = 1")).collect()}
    assert physical == {"Specific Gravity": (2.9, 0.0), "Bulk Density (g/cm³)": (1.5, 0.0)}


def test_profile_comparison(catalog, spark):
    pairs = spark.createDataFrame([("S001", "10084")], "simulant_id string, sample_id string")
    first = compose.first_components(catalog.chemical_compositions, "value_wt_pct").filter("component_name <> 'sum'")
    profile = compose.profile_components(catalog.lunar_reference, "chemical_composition")
    got = {r["component_name"]: (r["value_1"], r["value_2"], r["delta"]) for r in compose.compare_to_profiles(first, profile, pairs).collect()}
    assert got == {"SiO2": (40.0, 42.0, -2.0), "MgO": (0.0, 7.0, None), "FeO": (8.0, 0.0, None)}
    groups = compose.first_components(catalog.mineral_groups, "value_pct", "group_id", "group_name")
    minerals = compose.profile_components(catalog.lunar_reference, "mineral_composition")
    aliased = compose.compare_to_profiles(groups, minerals, pairs, {"Plagioclase Feldspar": "Plagioclase"}).collect()
    assert [(r["component_name"], r["delta"]) for r in aliased] == [("Plagioclase", 39.0)]
    assert ids(catalog.lunar_reference.transform(filters.profiles_with_chemistry).withColumnRenamed("sample_id", "simulant_id")) == ["10084"]


def test_families_are_dense(catalog):
    rows = catalog.compositions.select("simulant_id", "component_name", F.col("value_pct").alias("value"))
    got = {(r[0], r[1]): r[2] for r in compose.family_shares(rows).collect()}
    assert len(got) == 15 and got[("S001", "Plagioclase Feldspar")] == 60.0 and got[("S001", "Glass")] == 0.0


def test_integrity(catalog):
    issues = quality.integrity_issues(catalog)
    got = {(r["check"], r["key"]) for r in issues.collect()}
    assert ("orphan:chemical_compositions", "S999") in got and ("orphan:simulant_extra", "S998") in got
    assert ("nonstandard_availability", "Odd") in got and ("missing_child", "references") in got
    assert quality.verdict(issues).first()["result"] == "FAIL"
    doubled = catalog.simulants.unionByName(catalog.simulants.filter("simulant_id = 'S001'"))
    assert [(r[0], r[1]) for r in quality.duplicate_keys(doubled, ["simulant_id"]).collect()] == [("S001", 2)]
    kept, bad = quality.enforced(catalog.chemical_compositions, catalog.simulants, "simulant_id", "simulant_id")
    assert (kept.count(), bad.count()) == (8, 1)
    seen = {r["child"]: (r["covered"], r["missing"], r["total"]) for r in quality.coverage(
        catalog.simulants, {"chem": catalog.chemical_compositions}, "simulant_id", "simulant_id").collect()}
    assert seen == {"chem": (3, 2, 4)}


def test_sum_tolerance(spark):
    rows = spark.createDataFrame([("a", 100.00000000000001), ("b", 60.0), ("b", 41.0)], "simulant_id string, v double")
    assert ids(compose.totals_above(rows, "v")) == ["b"]
