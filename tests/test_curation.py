from __future__ import annotations

import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stratalog.operators import backfill, cluster, linkage, mentions, merge, ordering
from stratalog.session import durable


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    """Small tables usually end up in one part; without coalescing groups span several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


def test_positions_and_forward_fill(spark, coalescing):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("aaab"), rnd.choice([None, None, f"v{i}"])) for i in range(500)]
    count, carried, want = {}, {}, {}
    for i, k, v in rows:
        count[k] = count.get(k, 0) + 1
        carried[k] = v or carried.get(k)
        want[i] = (count[k], carried[k])
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k string, v string").repartition(3)
    placed = ordering.with_position(df, [F.col("i")], ["k"])
    filled = {r["i"]: r["v"] for r in ordering.forward_filled(df, "v", [F.col("i")], ["k"]).collect()}
    assert {r["i"]: (r["position"], filled[r["i"]]) for r in placed.collect()} == want
    spread_over = ordering._range_parts(df, ["k"], [F.col("i")]).select("_part").distinct().count()
    assert (spread_over > 1) == (coalescing == "false")
    overall = ordering.with_position(df, [F.desc("i")]).orderBy("position").collect()
    assert [r["i"] for r in overall] == list(range(499, -1, -1))


def test_new_keys(spark):
    old = spark.createDataFrame([("CH009",), ("CH998",), ("X1",), ("CHx",)], "id string")
    new = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    got = sorted(tuple(r) for r in ordering.with_new_keys(new, old, "id", "CH", [F.col("v")]).collect())
    assert got == [("CH1000", "b"), ("CH1001", "c"), ("CH999", "a")]


def test_append_is_guarded(spark):
    old = spark.createDataFrame([("CH001", "S1", 1.0)], "id string, simulant_id string, v double")
    new = spark.createDataFrame([("S2", 2.0)], "simulant_id string, v double")
    assert sorted(r["id"] for r in merge.appended(old, new, "id", "CH", [F.col("simulant_id")]).collect()) == ["CH001", "CH002"]
    with pytest.raises(ValueError, match="already present"):
        merge.appended(old, spark.createDataFrame([("S1", 2.0)], "simulant_id string, v double"), "id", "CH", [F.col("v")])
    with pytest.raises(ValueError, match="expected double"):
        merge.appended(old, spark.createDataFrame([("S2", "2")], "simulant_id string, v string"), "id", "CH", [F.col("v")])


def test_cascade(spark):
    targets = spark.createDataFrame(
        [("S1", "BH-1"), ("S2", "BH-2"), ("S3", "Kohyama"), ("S4", "LUNAR-mix"), ("S5", "abcdefghij"), ("S6", "abcdefghik")],
        "simulant_id string, name string")
    names = spark.createDataFrame([("BH-1/2",), ("BH-1",), ("Oshima",), ("lunar-MIX",), ("abcdefghi",), ("nothing",)], "name string")
    got = {(r["name"], r["simulant_id"]): r["stage"] for r in linkage.link_names(names, targets).collect()}
    assert got == {("BH-1/2", "S1"): "alias", ("BH-1/2", "S2"): "alias", ("BH-1", "S1"): "exact",
                   ("lunar-MIX", "S4"): "case", ("abcdefghi", "S5"): "fuzzy"}


def test_fuzzy_equals_brute_force(spark):
    rnd = random.Random(8)
    letters = "abcd-1"
    targets = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(150)]
    targets += ["long" + f"xyz{i}" * 15 for i in range(3)] + ["tide", "diet"]
    incoming = {"diet", "tide", "longxyz1" * 6}
    for t in targets:
        chars = list(t)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(chars)) if chars else 0
            chars[at:at + rnd.randint(0, 1)] = [rnd.choice(letters)] * rnd.randint(0, 1)
        incoming.add("".join(chars) or "z")
    keyed = [(f"S{i:03d}", t) for i, t in enumerate(targets)]
    want = {}
    for a in incoming:
        best = max(keyed, key=lambda kt: SequenceMatcher(None, a, kt[1]).ratio())
        score = SequenceMatcher(None, a, best[1]).ratio()
        if score > 0.8:
            want[a] = (best[0], score)
    got = linkage.fuzzy_matches(spark.createDataFrame([(a,) for a in sorted(incoming)], "name string"),
                                spark.createDataFrame(keyed, "simulant_id string, name string"))
    assert {r["name"]: (r["simulant_id"], r["ratio"]) for r in got.collect()} == want


def test_a_piece_in_a_third_of_all_names_is_split(spark):
    """No group of the join of pieces compares more than the bound, and nothing is lost."""
    rnd = random.Random(2)
    targets = [(f"S{k:04d}", ("common stem of names " if k % 3 == 0 else "".join(rnd.choice("abcdefghij") for _ in range(12))) + f"{k:04d}") for k in range(900)]
    names = [(t + "x",) for _, t in targets]
    left = spark.createDataFrame([(a, -1 if k % 3 == 0 else k) for k, (a,) in enumerate(names)], "a string, key bigint")
    right = spark.createDataFrame([(t, -1 if k % 3 == 0 else k) for k, (_, t) in enumerate(targets)], "b string, key bigint")
    old, linkage._SHARING = linkage._SHARING, 40
    try:
        met = linkage._met(left, right)
        groups = [r["count"] for r in met.groupBy("key", "i", "j").count().collect()]
        assert sum(groups) == 300 * 300 + 600 and max(groups) <= 4 * 40 * 40 and len(groups) >= 600 + 63
        assert met.select("a", "b").distinct().count() == sum(groups)
        got = linkage.fuzzy_matches(spark.createDataFrame(names[:60], "name string"), spark.createDataFrame(targets[:90], "simulant_id string, name string"))
        found = {r["name"]: r["simulant_id"] for r in got.collect()}
    finally:
        linkage._SHARING = old
    want = {}
    for (a,) in names[:60]:
        scores = [SequenceMatcher(None, a, t).ratio() for _, t in targets[:90]]
        if max(scores) > 0.8:
            want[a] = targets[scores.index(max(scores))][0]
    assert found == want


def greedy(points, radius):
    founder = {}
    for i, (_, lat, lon) in enumerate(points):
        if i in founder:
            continue
        for j in range(i, len(points)):
            a, b = points[j][1] - lat, points[j][2] - lon
            if j not in founder and math.sqrt(a * a + b * b) <= radius:
                founder[j] = i
    return founder


@pytest.mark.parametrize("radius,rows_per_salt", [(0.5, 250_000), (3.0, 250_000), (0.9, 5)])
def test_clusters_equal_greedy_loop(spark, monkeypatch, radius, rows_per_salt):
    monkeypatch.setattr(cluster, "_ROWS_PER_SALT", rows_per_salt)
    rnd = random.Random(int(radius * 10))
    # A third of all points lies in one spot, many on equal coordinates.
    points = [(i, round(rnd.uniform(0, .3), 2), 0.1) if i % 3 == 0 else (i, round(rnd.uniform(-6, 6), 1), round(rnd.uniform(-6, 6), 1))
              for i in range(300)]
    df = spark.createDataFrame(points, "ord long, lat double, lon double")
    want = greedy(points, radius)
    assert {r["ord"]: r["founder"] for r in cluster.cluster_members(df, radius).collect()} == want
    sizes = {r["founder"]: r["count"] for r in cluster.clusters(df, radius).collect()}
    assert sizes == {f: list(want.values()).count(f) for f in set(want.values())}


def test_chain_of_points_and_zero_radius(spark):
    points = [(i, float(i) * 0.6, 0.0) for i in range(12)]
    df = spark.createDataFrame(points, "ord long, lat double, lon double")
    assert {r["ord"]: r["founder"] for r in cluster.cluster_members(df, 1.0).collect()} == greedy(points, 1.0)
    assert {r["ord"]: r["founder"] for r in cluster.cluster_members(df, 0.0).collect()} == {i: i for i in range(12)}


@pytest.mark.parametrize("spacing", [0.3, 0.6])
def test_long_chains_end_in_few_rounds(spark, monkeypatch, spacing):
    """Points along a line in the order of their ids wait for each other from end to end."""
    points = [(i, i * spacing, (i % 3) * 0.1) for i in range(10_000)]
    rounds, walked = [], cluster._walked
    monkeypatch.setattr(cluster, "_walked", lambda undecided, side: rounds.append(side) or walked(undecided, side))
    got = cluster.cluster_members(spark.createDataFrame(points, "ord long, lat double, lon double"), 1.0)
    founders, want = [], {}
    for i, lat, lon in points:  # earlier founders within the radius are among the last few
        near = [f for f in founders[-8:] if math.sqrt((points[f][1] - lat) ** 2 + (points[f][2] - lon) ** 2) <= 1.0]
        want[i] = near[0] if near else i
        founders += [] if near else [i]
    assert {r["ord"]: r["founder"] for r in got.collect()} == want
    assert len(rounds) <= 8 and rounds[-1] > rounds[0]


@pytest.mark.parametrize("heads", [2, 16])
def test_many_radii_share_their_rounds(spark, monkeypatch, heads):
    monkeypatch.setattr(cluster, "_HEADS", heads)
    monkeypatch.setattr(cluster, "_FIRST_SIDE", 4)
    rnd = random.Random(heads)
    points = [(i, rnd.choice([i * 0.01, round(rnd.uniform(0, 3), 2)]), round(rnd.uniform(0, 3), 1)) for i in range(300)]
    df = spark.createDataFrame(points + [(300, None, 1.0), (301, float("nan"), 1.0)], "ord long, lat double, lon double")
    starts, minima = [], cluster._founders
    monkeypatch.setattr(cluster, "_founders", lambda cells, hot: starts.append(1) or minima(cells, hot))
    radii = [0.15, 0.4, 1.0, 0.0]
    got = {(r["radius"], r["founder"]): r["count"] for r in cluster.clusters_of(df, radii).collect()}
    want = {}
    for radius in radii:
        found = greedy(points, radius) if radius else {i: i for i, _, _ in points}
        for f in [*found.values(), 300, 301]:
            want[radius, f] = want.get((radius, f), 0) + 1
    assert got == want and len(starts) == 1


def pattern(name):
    return re.compile(r"(?<![A-Za-z0-9])" + re.escape(name).replace(r"\-", r"[\s\-]?") + r"(?![A-Za-z0-9])", re.I)


@pytest.mark.parametrize("names", [
    ["JSC-1A", "JSC-1", "A-A", "A-A-A", "BH-1/2", "GRC-1, -3", "(LHS)", "Chang'e", "月-壤", "x", "-X", "X-", "NU-LHT-2M", "C++", "1-1", "σ-1"],
    ["JSC", "x", "K2", "s", "istanbul", "1"],
])
def test_mentions_equal_pattern_search(spark, names):
    rnd = random.Random(3)
    bits = ["JSC", "1A", "1", "-", " ", "\xa0", "\n", "A", "a", "BH", "/", "2", "GRC", ", ", "3", "(", "LHS", ")", "Chang'e", "月", "壤", "x", "X",
            "ſ", "s", "K", "K", "2", "istanbul", "İstanbul", "ıstanbul", "NU", "LHT", "2M", "C++", "\x1c", "é", "_", "σ", "ς", "Σ"]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(1500)]
    want = {(i, n): len(pattern(n).findall(d)) for n in names for i, d in docs if pattern(n).search(d)}
    got = mentions.count_mentions(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r["doc"], r["name"]): r["mentions"] for r in got.collect()} == want


def sheet(spark, rows):
    fields = ("name", "type", "institution", "stage", "release_date", "notes", "specific_gravity", "tons_produced", "classification", "application",
              "feedstock", "replica_of", "grain_size_mm", "petrographic_class", "reference", "publicly_available",
              "mineral_composition_raw", "chemical_composition_raw")
    return spark.createDataFrame([(i, *[r.get(f) for f in fields]) for i, r in enumerate(rows)],
                                 "ord int, " + ", ".join(f"{f} string" for f in fields))


def test_merge(spark, catalog):
    rows = sheet(spark, [
        dict(name="beta", type="Dust", stage="Limited stock", release_date="1999", notes="null", publicly_available="True",
             mineral_composition_raw='{"F": {"A": 0}}', chemical_composition_raw="SiO2;40"),
        dict(name="BETA", type="Other", notes="kept", release_date="soon"),
        dict(name="Zeta", type="Highland", stage="Planned", mineral_composition_raw='{"F": {"A": 0}}', chemical_composition_raw="SiO2;40;x"),
        dict(name="Zeta", mineral_composition_raw='{"F": {"A": 5}}'),
        dict(name="alpha", chemical_composition_raw='{"FeO": 3, "MgO": null}'),
        dict(name="unknown thing", type="Mare"),
    ])
    links = linkage.link_names(rows, catalog.simulants)
    entities, extras = merge.merge_entities(rows, links, catalog.simulants, catalog.simulant_extra)
    got = {r["simulant_id"]: r for r in entities.collect()}
    assert (got["S002"]["type"], got["S002"]["notes"], got["S002"]["release_date"]) == ("Highland", "kept", "n/a")
    assert (got["S003"]["type"], got["S003"]["availability"]) == ("Highland", "Odd")
    assert sorted(got["S003"]["filled_fields"]) == ["type"]
    flags = {r["simulant_id"]: r["publicly_available_composition"] for r in extras.collect()}
    assert flags["S002"] is False
    minerals = merge.merge_minerals(rows, links, catalog.compositions)
    assert minerals.collect() == []  # the first row of Zeta parses and so claims it
    chemistry = merge.merge_chemistry(rows, links, catalog.chemical_compositions)
    assert sorted((r["simulant_id"], r["component_name"], r["value_wt_pct"]) for r in chemistry.collect()) == [("S003", "SiO2", 40.0), ("S010", "FeO", 3.0)]
    report = {r["measure"]: r["n"] for r in merge.merge_statistics(rows, links, entities, extras, minerals, chemistry).collect()}
    assert (report["rows_matched"], report["rows_unmatched"], report["chemistry_added"], report["minerals_added"]) == (5, 1, 2, 0)
    assert report["fields_filled"] == 2


def test_sourcing(spark, catalog):
    refined = spark.createDataFrame([(0, "Anorthite", "Plagioclase", None, "Co"), (1, "New", "Ore", "pit", None)],
                                    "ord int, name string, source_mineral string, mining_locations string, mining_company string")
    preliminary = spark.createDataFrame([(0, None, "lost"), (1, "Augite", None), (2, None, "Exo"), (3, "Absent", "x")],
                                        "ord int, constituent string, supplier string")
    for c in ("chemistry", "description", "description_simple", "further_reading", "european_sources"):
        preliminary = preliminary.withColumn(c, F.lit(None).cast("string"))
    got = {r["mineral_name"]: r for r in merge.merge_sourcing(catalog.mineral_sourcing, refined, preliminary).collect()}
    assert set(got) == {"anorthite", "AUGITE", "New"}
    assert (got["anorthite"]["source_mineral"], got["anorthite"]["chemistry"]) == ("Plagioclase", "Plagioclase")
    assert got["AUGITE"]["supplier"] == "Exo" and got["AUGITE"]["available_europe"] is True and got["New"]["chemistry"] == "Ore"


def test_backfill(spark):
    entities = spark.createDataFrame([("S1", "A-1"), ("S2", "B-2"), ("S3", "C-3"), ("S4", "D-4")], "simulant_id string, name string")
    refs = spark.createDataFrame([("R007", "S1", "known")], "reference_id string, simulant_id string, reference_text string")
    found = spark.createDataFrame([("db.html", "B-2", 9), ("p.html", "B-2", 2), ("o.html", "B-2", 2), ("db.html", "C-3", 1), ("gone.html", "D-4", 1)],
                                  "file string, name string, mentions long")
    titles = spark.createDataFrame([("db.html", "A Database"), ("p.html", "P"), ("o.html", "O"), ("gone.html", "G")], "file string, title string")
    texts = spark.createDataFrame([("o.html", "x\nA proper title line\n10.5555/abc.")], "file string, text string")
    curated = spark.createDataFrame([("z.html", "Z", None, None, None, None, "review")],
                                    "file string, title string, authors string, year int, doi string, url string, reference_type string")
    new = backfill.new_citations(entities, refs, backfill.best_sources(found, titles), texts, curated).orderBy("reference_id").collect()
    assert [(r["reference_id"], r["simulant_id"], r["title"], r["doi"]) for r in new] == [
        ("R008", "S2", "A proper title line", "10.5555/abc"), ("R009", "S4", "gone.html", None)]


def test_reports(spark):
    entities = spark.createDataFrame([(f"S{i}", n) for i, n in enumerate(["aa", "b", "b", "c", "d", "e", "f", "g", "h", "none"])],
                                     "simulant_id string, name string")
    docs = spark.createDataFrame([("x", "aa aa b c d e f g h aa", "T" * 70), ("y", "b", "U")], "doc string, text string, title string")
    hits = mentions.count_mentions(docs, entities)
    index = mentions.document_index(hits, entities, docs)
    report = mentions.multi_entity_report(index).collect()
    assert [(r["doc"], r["entity_count"], r["entities"], len(r["title"])) for r in report] == [
        ("x", 9, "aa(3), b(1), b(1), c(1), d(1), e(1), f(1), g(1) +1 more", 60)]
    sources = {r["simulant_id"]: (r["source_count"], r["top_source"]) for r in mentions.entity_sources(hits, entities).collect()}
    assert sources["S1"] == (2, "x") and sources["S0"] == (1, "x")
    assert [r["simulant_id"] for r in mentions.uncovered_entities(hits, entities).collect()] == ["S9"]


def test_merge_job(spark, catalog):
    from stratalog.plans import jobs

    rows = sheet(spark, [dict(name="Zeta", type="Mare", mineral_composition_raw='{"F": {"A": 5, "B": 2.5}}'),
                         dict(name="Zeta", chemical_composition_raw="SiO2;40")])
    done = jobs.curate(catalog, rows)
    added = {(r["composition_id"], r["component_name"], r["value_pct"]) for r in done.catalog.compositions.filter("simulant_id = 'S003'").collect()}
    assert added == {("C004", "A", 5.0), ("C005", "B", 2.5)}
    assert {r["composition_id"] for r in done.catalog.chemical_compositions.filter("simulant_id = 'S003'").collect()} == {"CH1001"}
    assert done.catalog.simulants.filter("simulant_id = 'S003'").first()["type"] == "Mare"
    assert done.issues.filter("severity = 'error'").count() > 0


def test_index_job(spark, table):
    from stratalog.plans import jobs

    entities = spark.createDataFrame([("S1", "JSC-1"), ("S2", "LHS")], "simulant_id string, name string")
    docs = spark.createDataFrame([("a.html", "JSC 1 and JSC-1 in one long line", "A"), ("b.html", "JSC1", "B")],
                                 "file string, text string, title string")
    curated = spark.createDataFrame([], "file string, title string, authors string, year int, doi string, url string, reference_type string")
    done = jobs.index_sources(docs, entities, table("references", []), curated)
    assert [(r["reference_id"], r["simulant_id"], r["title"]) for r in done.references.collect()] == [
        ("R001", "S1", "JSC 1 and JSC-1 in one long line")]
    assert {r["child"]: r["missing"] for r in done.change.collect()} == {"before": 2, "after": 1}
    assert [r["simulant_id"] for r in done.reports["uncovered"].collect()] == ["S2"]


def test_no_join_of_names_goes_through_the_driver(spark):
    """Small files of names make many keys, which Spark's estimate does not see: it broadcast them until the driver's memory ended."""
    names = durable(spark.createDataFrame([(f"name {k}",) for k in range(30)], "name string"))
    targets = durable(spark.createDataFrame([(f"S{k}", f"Name-{k}") for k in range(30)], "simulant_id string, name string"))
    a, b = names.select(F.col("name").alias("a")), targets.select(F.col("name").alias("b"))
    keyed = [durable(side.withColumn("key", F.xxhash64(F.lit(1)))) for side in (a, b)]

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (linkage._close_pairs(a, b, 2), linkage.link_names(names, targets, durable(targets.select("name", F.col("name").alias("target"))), fuzzy=False)):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    assert "SortMergeJoin [key" in plan(linkage._met(*keyed)) and linkage._met(*keyed).count() == 900
