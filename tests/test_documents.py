"""JSON documents in byte ranges against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratalog import schemas
from stratalog.sources import sinks
from stratalog.sources.catalog import Catalog
from stratalog.sources.documents import document_rows, follow, row_of

ODD = ['plain', 'a } b', '"{[', '\\', '\\"}', 'é}漢', 'line\nbreak}', '}}}', '[{"x": 1}]', '", "sites": [{', '']


def document(r, n):
    def value(depth=0):
        kind = r.randrange(6 if depth < 2 else 3)
        if kind < 2:
            return r.choice(ODD)
        if kind == 2:
            return r.choice([1, -2.5, None, True])
        if kind == 3:
            return [value(depth + 1) for _ in range(r.randrange(3))]
        return {r.choice(ODD) + str(k): value(depth + 1) for k in range(r.randrange(3))}

    tables = {t: [{"id": f"{t}{k}", **{f"v{i}": value() for i in range(r.randrange(4))}} for k in range(r.randrange(n))] for t in ("a", "b } [", 'c "q"', "empty", "d")}
    tables["empty"] = []
    rest = {"meta": {"a": {"b": {}}, "rows": [{"no": "row"}]}, "note": "} [{", "numbers": [1, 2, [3]], "nothing": None}
    items = [*tables.items(), *rest.items()]
    r.shuffle(items)
    return dict(items), tables


@pytest.mark.parametrize("block", ["32", "211", "1m"])
def test_documents_in_byte_ranges_equal_the_json_module(spark, tmp_path, block):
    r = random.Random(int(block.rstrip("m")))
    want = []
    for k, indent in enumerate((None, 2, None)):
        whole, tables = document(r, 14)
        (tmp_path / f"{k}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=k == 2) + "\n" * k, encoding="utf-8")
        want += [(f"{k}.json", t, json.dumps(row, sort_keys=True)) for t, rows in tables.items() for row in rows]
    (tmp_path / "3.json").write_text("{}")
    (tmp_path / "4.json").write_text("")
    sizes = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "1"}
    before = {c: spark.conf.get(c) for c in sizes}
    try:
        for c, v in sizes.items():
            spark.conf.set(c, v)
        got = document_rows(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1)).orderBy("file", "number").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((g["file"], g["table"], json.dumps(json.loads(g["row"]), sort_keys=True)) for g in got) == sorted(want)
    assert len({(g["file"], g["number"]) for g in got}) == len(got)
    # Rows of a table come in the document's order.
    for file, table in {(g["file"], g["table"]) for g in got}:
        ids = [json.loads(g["row"])["id"] for g in got if (g["file"], g["table"]) == (file, table)]
        assert ids == [f"{table}{k}" for k in range(len(ids))]


def test_pieces_and_rows():
    assert follow('{"a": [{"b": "x', False) == (True, 3)
    assert follow('y", "c": 1', True) == (False, -1)
    assert follow("", False) == (False, -1)
    assert row_of('{"t": [ {"a": {"b": 1}}', True) == ("t", '{"a": {"b": 1}}')
    assert row_of(', {"a": 1}', False) == (None, '{"a": 1}')
    assert row_of('], "k": {"a": 1}', False) == (None, None)


def test_bundle_without_a_table(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"sites": [], "generated": {"at": "now"}, "simulants": [{"simulant_id": "S1", "name": "a}b", "specific_gravity": "2.5"}]}')
    bundle = Catalog.load_bundle(spark, str(tmp_path / "b.json"))
    assert [(r["simulant_id"], r["name"], r["specific_gravity"]) for r in bundle.simulants.collect()] == [("S1", "a}b", 2.5)]
    assert bundle.sites.count() == 0 and bundle.compositions.schema == schemas.TABLES["compositions"][0]


def test_bundle_documents_come_back(spark, tmp_path, catalog):
    sinks.write_bundle_documents(catalog, str(tmp_path / "bundle"))
    full = [p for p in sorted((tmp_path / "bundle").glob("*/part-*")) if p.stat().st_size]
    for path in full:
        assert list(json.loads(path.read_text())) == [path.parent.name]
    back = Catalog.load_bundle(spark, str(tmp_path / "bundle"))
    for name, (schema, keys) in schemas.TABLES.items():
        kept = catalog.tables[name].dropna(subset=["lat", "lon"]) if name == "sites" else catalog.tables[name]
        want = kept.select(schema.fieldNames())
        assert sorted(map(str, back.tables[name].collect())) == sorted(map(str, want.collect())), name
        ids = [row[keys[0]] for p in full if p.parent.name == name for row in json.loads(p.read_text())[name]]
        assert ids == [r[0] for r in sinks.bundle_tables(catalog)[name].select(keys[0]).collect()], name
