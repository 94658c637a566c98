"""They must equal the catalogue's published ones for right results."""

# Member states of the bloc filter, ISO-3 code and English name.
EU_MEMBERS = {
    "AUT": "Austria", "BEL": "Belgium", "BGR": "Bulgaria", "HRV": "Croatia", "CYP": "Cyprus",
    "CZE": "Czech Republic", "DNK": "Denmark", "EST": "Estonia", "FIN": "Finland", "FRA": "France",
    "DEU": "Germany", "GRC": "Greece", "HUN": "Hungary", "IRL": "Ireland", "ITA": "Italy",
    "LVA": "Latvia", "LTU": "Lithuania", "LUX": "Luxembourg", "MLT": "Malta", "NLD": "Netherlands",
    "POL": "Poland", "PRT": "Portugal", "ROU": "Romania", "SVK": "Slovakia", "SVN": "Slovenia",
    "ESP": "Spain", "SWE": "Sweden",
}

# Display name of a country code.
COUNTRY_DISPLAY = {
    "USA": "United States", "GBR": "United Kingdom", "CHN": "China", "JPN": "Japan", "DEU": "Germany",
    "FRA": "France", "ITA": "Italy", "KOR": "South Korea", "IND": "India", "CAN": "Canada",
    "AUS": "Australia", "BRA": "Brazil", "RUS": "Russia", "EU": "European Union", "POL": "Poland",
    "NOR": "Norway", "CHE": "Switzerland", "ISR": "Israel", "ARE": "UAE", "DNK": "Denmark",
    "NLD": "Netherlands", "ESP": "Spain", "AUT": "Austria", "FIN": "Finland", "BEL": "Belgium",
    "SWE": "Sweden", "CZE": "Czech Republic", "PRT": "Portugal", "HUN": "Hungary", "GRC": "Greece",
    "TWN": "Taiwan",
}

# Agency name contained in an institution -> home page, first match wins.
INSTITUTION_URLS = {
    "NASA": "https://www.nasa.gov",
    "ESA": "https://www.esa.int",
    "JAXA": "https://www.jaxa.jp/en/",
    "CNES": "https://cnes.fr/en",
    "DLR": "https://www.dlr.de/en",
    "ISRO": "https://www.isro.gov.in",
    "CSA": "https://www.asc-csa.gc.ca/eng/",
    "CNSA": "https://www.cnsa.gov.cn",
}

# Fixed values: (texts contained, texts equal, mission) to infer a reference profile, first match wins.
PROFILE_RULES = (
    (("apollo 11",), ("10084",), "Apollo 11"),
    (("apollo 12",), ("12070",), "Apollo 12"),
    (("apollo 14",), ("14163",), "Apollo 14"),
    (("apollo 15",), ("15271",), "Apollo 15"),
    (("apollo 16",), ("60501",), "Apollo 16"),
    (("apollo 17",), ("71501",), "Apollo 17"),
    (("chang'e", "change", "ce5"), (), "Chang'e-5"),
)

# Mineral -> family of the dense family table.
MINERAL_FAMILIES = {
    "Plagioclase Feldspar": ("Plagioclase", "Anorthite", "Labradorite", "Bytownite", "Albite", "Anorthosite"),
    "Pyroxene": ("Augite", "Clinopyroxene", "Orthopyroxene", "Bronzite"),
    "Olivine": ("Olivine", "Forsterite", "Fayalite"),
    "Ilmenite": ("Ilmenite",),
    "Glass": ("Glass", "Volcanic Glass", "Agglutinate", "Glass-rich Basalt"),
}

# Family name in the catalogue -> component name in the reference profiles.
FAMILY_ALIASES = {"Plagioclase Feldspar": "Plagioclase"}

# Spreadsheet name -> catalogue names it stands for.
NAME_ALIASES = {
    "BH-1/2": ("BH-1", "BH-2"),
    "CLRS-1/2": ("CLRS-1", "CLRS-2"),
    "GRC-1, -3": ("GRC-1", "GRC-3"),
    "Kohyama": ("Kohyama Simulant",),
    "NEU-1/3": ("NEU-1", "NEU-1A", "NEU-1B"),
    "Oshima": ("Oshima Simulant",),
    "TJ-1/TJ-2": ("TJ-1", "TJ-2"),
    "UOM-Black": ("UoM-B",),
    "UOM-White": ("UoM-W",),
    "Chenobi": ("CHENOBI",),
    "CLDS-1": ("CLDS-i",),
}

# Spreadsheet stage -> availability; other stages are kept as they are.
STAGE_AVAILABILITY = {
    "Available": "Available",
    "Limited stock": "Limited Stock",
    "Production stopped": "Production stopped",
}

# Standard availability values.
STANDARD_AVAILABILITY = ("Available", "Unknown", "Production stopped", "Limited Stock")

# Titles holding one of these words are indexes of sources, not sources.
META_TITLE_WORDS = ("Dashboard", "Database", "Registry", "Dataset", "Wikipedia")

# Spreadsheet header -> field.
SPREADSHEET_COLUMNS = {
    "Simulant name": "name",
    "Type": "type",
    "Country": "country",
    "Classification (https://ntrs.nasa.gov/citations/20240011783)": "classification",
    "Application": "application",
    "Column 1": "city",
    "Institution": "institution",
    "Stage": "stage",
    "Release Date": "release_date",
    "Replica of": "replica_of",
    "Notes": "notes",
    "Reference": "reference",
    "Publicly available composition": "publicly_available",
    "Feedstock": "feedstock",
    "Petrographic Class (Composition:Percentage)": "petrographic_class",
    "Mineral Composition (Composition;Percentage)": "mineral_composition_raw",
    "Chemical Composition": "chemical_composition_raw",
    "Tons produced": "tons_produced",
    "Grain Size (mm)": "grain_size_mm",
    "Specific Gravity": "specific_gravity",
}

# Base column -> header of the wide export.
EXPORT_COLUMNS = {
    "simulant_id": "Simulant ID",
    "name": "Name",
    "type": "Type",
    "country_code": "Country",
    "institution": "Institution",
    "availability": "Availability",
    "release_date": "Release Date",
    "tons_produced_mt": "Tons Produced (MT)",
    "specific_gravity": "Specific Gravity",
    "notes": "Notes",
    "lunar_sample_reference": "Lunar Sample Reference",
}

# Physical property -> (label, unit), in display order.
PHYSICAL_PROPERTIES = {
    "bulk_density": ("Bulk Density", "g/cm³"),
    "density_g_cm3": ("Density", "g/cm³"),
    "specific_gravity": ("Specific Gravity", ""),
    "cohesion": ("Cohesion", "kPa"),
    "friction_angle": ("Friction Angle", "°"),
    "particle_size_d50": ("Particle Size D50", "μm"),
    "particle_size_distribution": ("Particle Size Distribution", "μm"),
    "particle_morphology": ("Morphology", ""),
    "particle_ruggedness": ("Ruggedness", ""),
    "glass_content_percent": ("Glass Content", "%"),
    "nasa_fom_score": ("NASA FoM Score", ""),
    "ti_content_percent": ("Ti Content", "%"),
    "grain_size_mm": ("Grain Size", "mm"),
}

# Property -> label of the two-entity comparison.
COMPARED_PROPERTIES = {
    "specific_gravity": "Specific Gravity",
    "bulk_density": "Bulk Density (g/cm³)",
    "density_g_cm3": "Density (g/cm³)",
    "cohesion": "Cohesion (kPa)",
    "friction_angle": "Friction Angle (°)",
    "particle_size_d50": "Particle Size D50 (µm)",
    "glass_content_percent": "Glass Content (%)",
    "nasa_fom_score": "NASA FOM Score",
}

# Colour classes of map points, sites and availability badges.
TYPE_COLOURS = (("highland", "#94a8be"), ("mare", "#d4915c"))
TYPE_COLOUR_OTHER = "#9b8e82"
SITE_COLOURS = {"Apollo": "#f59e0b", "Luna": "#ef4444", "Chang-e": "#3b82f6"}
SITE_COLOUR_OTHER = "#a855f7"
AVAILABILITY_BADGES = {
    "Available": "emerald",
    "Available (Research)": "cyan",
    "Limited Stock": "amber",
    "Production stopped": "red",
    "Unavailable": "slate",
}

# Headings of the Markdown report, by section.
REPORT_HEADINGS = {
    1: ("# Source-Simulant Reference Index", ""),
    2: ("## Multi-Simulant Sources (5+ simulants)", "", "| Source | Simulants | Title |", "|--------|-----------|-------|"),
    3: ("", "## Simulant Coverage", "", "| Simulant | Sources | Top Source |", "|----------|---------|------------|"),
    4: ("", "## Simulants with No Source Coverage", ""),
}
REPORT_ALL_COVERED = "All simulants have at least one source."
