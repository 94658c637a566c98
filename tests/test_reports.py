"""The Markdown report, previews and single-entity exports."""

from pathlib import Path

from stratalog import fixed
from stratalog.operators import backfill, mentions, reports
from stratalog.sources import sinks


def report(spark, entities):
    docs = spark.createDataFrame([(f"{c}.html", f"Title of {c} " + "x" * 60) for c in "abc"], "file string, title string")
    hits = spark.createDataFrame([("a.html", n, 2) for n in ("N1", "N2", "N3", "N4", "N5")] + [("b.html", "N1", 9)], "file string, name string, mentions bigint")
    named = spark.createDataFrame(entities, "simulant_id string, name string")
    texts = docs.withColumn("text", docs["title"])
    index = mentions.document_index(hits, named, texts, "file")
    return reports.markdown_lines(mentions.corpus_totals(hits, docs, named, "file"), mentions.multi_entity_report(index, "file"),
                                  mentions.entity_sources(hits, named, "file"), mentions.uncovered_entities(hits, named), docs, "file")


def test_report_as_one_document(spark, tmp_path):
    entities = [(f"S{k}", f"N{k}") for k in range(1, 6)] + [("S10", "Other"), ("S9", "Another")]
    lines = report(spark, entities)
    sinks.write_lines(lines, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "report").glob("part-*")))
    names = ", ".join(f"N{k}(2)" for k in range(1, 6))
    want = ["# Source-Simulant Reference Index", "", "Generated from 3 sources", "", "**2** sources mention at least one simulant.", "",
            *fixed.REPORT_HEADINGS[2], f"| a.html | {names} | {('Title of a ' + 'x' * 60)[:60]} |", *fixed.REPORT_HEADINGS[3],
            *[f"| N{k} | {2 if k == 1 else 1} | {('Title of a ' + 'x' * 60)[:40]} |" for k in range(1, 6)],
            *fixed.REPORT_HEADINGS[4], "- Another (S9)", "- Other (S10)"]
    assert text.splitlines() == want


def test_report_says_that_all_are_covered(spark):
    rows = report(spark, [("S1", "N1")]).orderBy("section", "position").collect()
    assert rows[-1]["line"] == fixed.REPORT_ALL_COVERED
    assert [r["position"] for r in rows if r["section"] == 4] == [1, 2, 3, 4]


def test_preview_takes_the_first_keys(spark):
    rows = spark.createDataFrame([(f"R{k:03d}", "S1") for k in (1200, 7, 999, 8, 1000, 9)], "reference_id string, simulant_id string")
    assert [r["reference_id"] for r in backfill.preview(rows).collect()] == ["R007", "R008", "R009", "R999", "R1000"]
    assert backfill.preview(rows.limit(0)).count() == 0


def test_export_of_one_entity_has_its_own_columns(catalog):
    some = catalog.compositions.join(catalog.simulants, "simulant_id", "left_semi").select("simulant_id", "component_name").collect()
    one = some[0]["simulant_id"]
    wide = sinks.entity_export(catalog, one)
    minerals = {c for c in wide.columns if c.startswith("Mineral: ")}
    assert minerals == {f"Mineral: {r['component_name']} (%)" for r in some if r["simulant_id"] == one}
    assert wide.count() == 1
