"""What tags mean: semantic categories, road and land-use classes, descriptions; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories in order of priority, each with its (key, allowed values or None for any)
CATEGORIES: dict[str, list[tuple[str, tuple[str, ...] | None]]] = {
    "food_drink": [("amenity", ("restaurant", "cafe", "bar", "fast_food", "pub", "food_court", "ice_cream", "biergarten", "bbq"))],
    "retail": [("shop", None)],
    "transport": [("highway", None), ("railway", None), ("public_transport", None)],
    "education": [("amenity", ("school", "university", "college", "kindergarten", "library", "research_institute"))],
    "nature_green": [("natural", None), ("landuse", ("forest", "meadow", "farmland", "grass", "heath", "orchard", "vineyard", "scrub"))],
    "leisure": [("leisure", None)],
    "water": [("waterway", None), ("water", None)],
    "tourism": [("tourism", None)],
    "built_environment": [("building", None)],
    "health": [("amenity", ("hospital", "clinic", "doctors", "pharmacy", "dentist", "nursing_home", "veterinary"))],
}
# fixed values: road classes and the highway values of each; the first two are major
ROADS = {
    "motorway_trunk": ("motorway", "motorway_link", "trunk", "trunk_link"),
    "primary": ("primary", "primary_link"),
    "secondary": ("secondary", "secondary_link", "tertiary", "tertiary_link"),
    "residential": ("residential", "living_street", "service", "unclassified"),
    "path": ("footway", "path", "cycleway", "pedestrian", "steps", "track"),
}
MAJOR = ("motorway_trunk", "primary")
# fixed values: land-use classes by key, in order of priority; None stands for any value
LANDUSE: list[tuple[str, str, tuple[str, ...] | None]] = [
    ("landuse", "residential", ("residential", "housing", "apartments")),
    ("landuse", "commercial", ("commercial", "retail", "office")),
    ("landuse", "industrial", ("industrial", "port", "quarry")),
    ("landuse", "natural", ("forest", "farmland", "meadow", "grass", "heath", "orchard", "vineyard", "scrub", "village_green")),
    ("landuse", "recreation", ("recreation_ground", "cemetery", "greenfield")),
    ("natural", "natural", None),
    ("leisure", "recreation", ("park", "garden", "playground", "nature_reserve", "golf_course")),
    ("building", "residential", ("residential", "house", "apartments", "detached", "semidetached_house", "terrace")),
    ("building", "commercial", ("commercial", "retail", "office", "shop")),
    ("building", "industrial", ("industrial", "warehouse", "factory")),
]
LANDUSE_CLASSES = ("residential", "commercial", "industrial", "natural", "recreation")
# fixed values: descriptions by key, in order of priority
TEMPLATES = {
    "amenity": "a {value}", "shop": "a {value} shop", "tourism": "a {value}", "leisure": "a {value}", "historic": "a historic {value}", "office": "a {value} office",
    "sport": "a {value} sports facility", "healthcare": "a {value}", "emergency": "a {value}", "craft": "a {value} workshop", "public_transport": "a {value} stop",
    "railway": "a {value}", "waterway": "a {value}", "water": "a {value} water body", "natural": "natural {value}", "landuse": "a {value} area", "highway": "a {value}",
    "building": "a {value} building", "man_made": "a {value}", "power": "a power {value}", "aeroway": "an aviation {value}", "barrier": "a {value} barrier",
    "military": "a military {value}", "place": "a {value}", "telecom": "a telecommunications facility",
}
DISTANCES = ("food_drink", "retail", "transport", "education", "leisure", "health")


def present(value: Column, *, none: bool = True) -> Column:
    """Whether a tag has a value: not null, blank or "nan" (nor, with none, "none")."""
    return F.coalesce((F.trim(value) != "") & ~F.lower(F.trim(value)).isin("nan", *(["none"] if none else [])), F.lit(False))


def _among(value: Column, allowed: tuple[str, ...] | None) -> Column:
    return present(value) if allowed is None else present(value) & F.trim(value).isin(*allowed)


def category(keys: list[str]) -> Column:
    """The first category, by priority, that a feature with columns `keys` falls in, or null."""
    out = F
    for name, rules in CATEGORIES.items():
        for key, allowed in rules:
            if key in keys:
                out = out.when(_among(F.col(key), allowed), name)
    return out.otherwise(None)


def road_class(value: Column) -> Column:
    out = F
    for name, values in ROADS.items():
        out = out.when(F.lower(F.trim(value)).isin(*values), name)
    return out.otherwise(None)


def landuse_class(keys: list[str]) -> Column:
    """The land-use class of a polygon: from landuse, else natural, leisure, building."""
    out = F
    for key, name, allowed in LANDUSE:
        if key in keys:
            value = F.col(key)
            out = out.when(present(value) if allowed is None else present(value) & F.lower(F.trim(value)).isin(*allowed), name)
    return out.otherwise(None)


def description(keys: list[str]) -> Column:
    """A phrase for a feature, from its first key that has a value."""
    out = F
    for key, template in TEMPLATES.items():
        if key in keys:
            head, _, tail = template.partition("{value}")
            value = F.replace(F.lower(F.trim(F.col(key))), F.lit("_"), F.lit(" "))
            out = out.when(present(F.col(key)), F.concat(F.lit(head), value, F.lit(tail)) if "{value}" in template else F.lit(template))
    return out.otherwise("an unclassified feature")
