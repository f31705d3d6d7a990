"""Settings of the observation engine."""

from __future__ import annotations

from dataclasses import dataclass

#: Families whose exports are read, in this order.
FAMILIES = ("droseraceae", "nepenthaceae", "sarraceniaceae", "roridulaceae", "byblidaceae", "lentibulariaceae", "cephalotaceae", "drosophyllaceae")

#: Columns of an export that are used.
OBS_COLUMNS = (
    "id", "observed_on", "time_observed_at", "user_id", "user_login", "quality_grade", "image_url", "captive_cultivated",
    "place_guess", "latitude", "longitude", "private_latitude", "private_longitude", "geoprivacy", "taxon_geoprivacy",
    "coordinates_obscured", "place_country_name", "scientific_name", "taxon_genus_name", "taxon_species_name",
    "taxon_hybrid_name", "taxon_subspecies_name", "taxon_variety_name",
)
OPTIONAL_COLUMNS = ("private_latitude", "private_longitude")

#: Fill colours by class index (0 stationary, 1 to 6 by rising speed, 7 instantaneous).
PALETTE = ("rgb(55,126,184)", "rgb(26,150,65)", "rgb(166,217,106)", "rgb(203,203,15)", "rgb(253,174,97)", "rgb(215,25,28)", "rgb(129,15,124)", "rgb(0,0,0)")
PALETTE_COLOR_BLIND = ("rgb(55,126,184)", "rgb(254,217,118)", "rgb(254,178,76)", "rgb(253,141,60)", "rgb(252,78,42)", "rgb(227,26,28)", "rgb(177,0,38)", "rgb(0,0,0)")
GRAY, WHITE, OUTLINE, BLACK, BAR = "rgb(128,128,128)", "rgb(255,255,255)", "DarkGrey", "rgb(0,0,0)", "rgb(100,100,100)"

#: Plausibility classes in the order in which they are reported, with their colour index (None: gray).
CLASSES = (
    ("first", None), ("instantaneous", 7), ("stationary", 0), ("kmh_0_5", 1), ("kmh_5_10", 2), ("kmh_10_25", 3),
    ("kmh_25_80", 4), ("kmh_80_200", 5), ("kmh_over_200", 6),
)


@dataclass(frozen=True)
class Config:
    """Thresholds and choices; each default is the reference behaviour unless a deployment must name it."""

    families: tuple[str, ...] = FAMILIES
    #: Family-level name that stands for its only genus.
    monotypic: tuple[str, str] = ("Nepenthaceae", "Nepenthes")
    #: Species of the four species slices.
    focus_species: str = "Drosera rotundifolia"
    #: Image addresses on other hosts are left out of the clean export.
    image_host: str = "https://images.example.org/"
    frequent_posts: int = 80
    top_posts: int = 10
    first_year_after: int = 1950
    marker: int = 8
    color_blind: bool = False

    @property
    def palette(self) -> tuple[str, ...]:
        return PALETTE_COLOR_BLIND if self.color_blind else PALETTE


DEFAULT = Config()
