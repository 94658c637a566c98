from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stratalog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows of dictionaries to a table in the given or declared schema."""
    from stratalog import schemas

    def make(name_or_ddl, rows):
        schema = schemas.TABLES[name_or_ddl][0] if name_or_ddl in schemas.TABLES else name_or_ddl
        if isinstance(schema, str):
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def catalog(spark, table):
    """A small catalogue with the odd cases of every table."""
    from stratalog.sources.catalog import Catalog

    simulants = [
        dict(simulant_id="S001", name="Éa-1", type="Mare", country_code="DEU", institution="NASA Kennedy", availability="Available",
             release_date="1994", lunar_sample_reference="10084", cohesion="0.3-1.2", bulk_density="1.5", specific_gravity=2.9,
             notes='a, "b"\nc'),
        dict(simulant_id="S002", name="beta", type="Highland", country_code="Spain", institution="nasa", availability="Limited Stock",
             release_date="n/a", lunar_sample_reference="Apollo 14 soil", cohesion="0", bulk_density="1.5d"),
        dict(simulant_id="S003", name="Zeta", type=None, country_code="USA", institution=None, availability="Odd",
             lunar_sample_reference="Chang'e 5", cohesion="n/a"),
        dict(simulant_id="S010", name="alpha", type="Mare", country_code="FRA", institution="ESA", availability="Available",
             release_date="2003"),
    ]
    chem = [
        ("CH001", "S001", "oxide", "SiO2", 40.0), ("CH002", "S001", "oxide", "SiO2", 50.0), ("CH003", "S001", "oxide", "sum", 99.0),
        ("CH004", "S001", "oxide", "TiO2", 0.0), ("CH005", "S002", "oxide", "SiO2", None), ("CH006", "S002", "oxide", "FeO", 12.5),
        ("CH009", "S999", "oxide", "FeO", 1.0), ("CH1000", "S001", "oxide", "FeO", 7.0), ("CH101", "S001", "oxide", "FeO", 8.0),
    ]
    minerals = [("C001", "S001", "mineral", "Anorthite", 60.0, "Feldspar"), ("C002", "S002", "mineral", "Augite", 0.0, "Pyroxene"),
                ("C003", "S010", "mineral", "Augite", 45.0, "Pyroxene")]
    groups = [("MG001", "S001", "Plagioclase Feldspar", 60.0), ("MG002", "S001", "Olivine", 0.0), ("MG003", "S002", "Olivine", 10.0)]
    refs = [
        dict(reference_id="R001", simulant_id="S001", reference_text="First paper (1999) https://a.org/x.", reference_type="composition"),
        dict(reference_id="R002", simulant_id="S001", reference_text="Second", reference_type="usage"),
        dict(reference_id="R003", simulant_id="S001", reference_text=None, title="T", authors="A", year=2001, doi="10.1234/z"),
        dict(reference_id="R004", simulant_id="S002", reference_text="Third", reference_type="review"),
        dict(reference_id="R010", simulant_id="S001", reference_text="Tenth", reference_type="composition"),
    ]
    sites = [("X1", "S001", "one", "lab", "DEU", 1.0, 1.0), ("X10", "S001", "ten", "lab", "DEU", 2.0, 2.0),
             ("X2", "S002", "two", "lab", "ESP", None, 3.0)]
    profiles = [("10084", "Apollo 11", "Sea", (0.6, 23.4), "Mare", "soil", {"SiO2": 42.0, "MgO": 7.0}, {"Plagioclase": 21.0}, ["a"]),
                ("0", "None", "Sea", (0.0, 0.0), "Mare", "soil", {}, None, [])]
    extra = [dict(simulant_id="S001", name="x", petrographic_class='{"Rocks": {"Basalt": 60, "Glass": 40.5, "Nil": 0}}',
                  replica_of="Luna 16", grain_size_mm="0.1-1"),
             dict(simulant_id="S002", name="y", petrographic_class="Basalt", publicly_available_composition=False),
             dict(simulant_id="S998", name="lost")]
    return Catalog.of(
        spark, simulants=table("simulants", simulants),
        chemical_compositions=spark.createDataFrame(chem, "composition_id string, simulant_id string, component_type string, component_name string, value_wt_pct double"),
        compositions=spark.createDataFrame(minerals, "composition_id string, simulant_id string, component_type string, component_name string, value_pct double, `group` string"),
        mineral_groups=spark.createDataFrame(groups, "group_id string, simulant_id string, group_name string, value_pct double"),
        references=table("references", refs),
        sites=spark.createDataFrame(sites, "site_id string, simulant_id string, site_name string, site_type string, country_code string, lat double, lon double"),
        lunar_reference=spark.createDataFrame(profiles, "sample_id string, mission string, landing_site string, coordinates struct<lat: double, lon: double>, type string, sample_description string, chemical_composition map<string, double>, mineral_composition map<string, double>, sources array<string>"),
        simulant_extra=table("simulant_extra", extra),
        mineral_sourcing=table("mineral_sourcing", [dict(mineral_name="anorthite", chemistry="CaAl"), dict(mineral_name="AUGITE", available_europe=True)]),
    )
