"""Point sets and tables for other tools: tab-separated slices, GPX, KML, KMZ and CSV, each a single document of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.functions import names
from perigon.operators import documents


def slice_predicates(config: Config = DEFAULT) -> dict[str, Column]:
    """The thirteen point sets, by name."""
    taxon, own, hidden = F.col("taxon_geoprivacy"), F.col("geoprivacy"), F.col("coordinates_obscured")
    focus = F.coalesce(F.col("scientific_name") == config.focus_species, F.lit(False))
    return {
        "all": F.lit(True),
        "precise": hidden == "false",
        "obscured": hidden == "true",
        "taxon_empty": taxon == "",
        "taxon_open": taxon == "open",
        "taxon_obscured": taxon == "obscured",
        "focus_empty": focus & (taxon == ""),
        "focus_open": focus & (taxon == "open"),
        "focus_empty_open": focus & taxon.isin("", "open"),
        "focus_obscured": focus & (taxon == "obscured"),
        "geoprivacy_empty": own == "",
        "geoprivacy_obscured": own == "obscured",
        "geoprivacy_private": own == "private",
    }


def slices(accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """slice, seq and the tab-separated line of every point of every slice, in one pass."""
    lat, lon = names.present(F.col("private_latitude"), F.col("latitude")), names.present(F.col("private_longitude"), F.col("longitude"))
    line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in (F.col("id"), F.col("user_id"), F.col("user_login"), lat, lon)])
    which = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in slice_predicates(config).items()]))
    return accepted.select(F.explode(which).alias("slice"), "seq", line.alias("line"))


def write_slices(accepted: DataFrame, folder: str, config: Config = DEFAULT) -> None:
    """One headerless tab-separated file for each slice, in input order; a slice without points is an empty file."""
    rows = slices(accepted, config).select(F.concat("slice", F.lit(".tsv")).alias("file"), "seq", F.col("line").alias("element"))
    documents.write_documents(rows, folder, ["seq"], names=[f"{n}.tsv" for n in slice_predicates(config)])


def waypoints(accepted: DataFrame, precise: bool = True) -> DataFrame:
    """seq, lat, lon and label of the points of the precise or the obscured track."""
    private = F.coalesce(F.col("private_latitude"), F.lit("")) != ""
    rows = accepted.filter((F.col("coordinates_obscured") == "false") | private) if precise else accepted.filter((F.col("coordinates_obscured") == "true") & ~private)
    lat = names.valued(F.col("private_latitude"), F.col("latitude")) if precise else F.col("latitude")
    lon = names.valued(F.col("private_longitude"), F.col("longitude")) if precise else F.col("longitude")
    label = F.concat("taxon_genus_name", F.lit(" "), names.epithet(F.col("taxon_hybrid_name"), F.col("taxon_species_name")))
    return rows.select("seq", lat.alias("lat"), lon.alias("lon"), label.alias("label"))


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="perigon" xmlns="http://www.topografix.com/GPX/1/1">'
KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'


def gpx_elements(points: DataFrame, compat: bool = False) -> DataFrame:
    """One waypoint element per row; `compat` leaves labels unescaped."""
    label = F.col("label") if compat else escaped(F.col("label"))
    element = F.concat(
        F.lit('  <wpt lat="'), "lat", F.lit('" lon="'), "lon", F.lit('">\n    <ele>0.000000</ele>\n    <name>'), label, F.lit("</name>\n    <cmt>"), label,
        F.lit("</cmt>\n    <desc>"), label, F.lit("</desc>\n    <cmt></cmt>\n    <desc></desc>\n  </wpt>"),
    )
    return points.select("seq", element.alias("element"))


def kml_elements(points: DataFrame) -> DataFrame:
    element = F.concat(F.lit("  <Placemark><name>"), escaped(F.col("label")), F.lit("</name><Point><coordinates>"), "lon", F.lit(","), "lat", F.lit(",0</coordinates></Point></Placemark>"))
    return points.select("seq", element.alias("element"))


def write_document(elements: DataFrame, folder: str, name: str, head: str, foot: str = "") -> None:
    """One file of the elements in input order between head and foot."""
    documents.write_documents(elements.withColumn("file", F.lit(name)), folder, ["seq"], head, foot, [name])


def write_gpx(points: DataFrame, folder: str, name: str = "track.gpx", compat: bool = False) -> None:
    write_document(gpx_elements(points, compat), folder, name, GPX_HEAD, "</gpx>")


def write_kml(points: DataFrame, folder: str, name: str = "track.kml") -> None:
    write_document(kml_elements(points), folder, name, KML_HEAD, "</Document></kml>")


def write_kmz(points: DataFrame, folder: str, name: str = "track.kmz") -> None:
    """The track as one KML document in one archive, deflated by the tasks that hold its points."""
    documents.write_zip(kml_elements(points), folder, name, "doc.kml", ["seq"], KML_HEAD, "</Document></kml>")


#: Header of the clean export.
CLEAN_HEADER = (
    "#observationID,serviceName,lat,long,elevation,genus,species,subspecies,variety,hybrid,country,date,"
    "location_information,picture_author,picture_author_id,status_of_verification_by_TI,image_URL"
)


def clean_lines(accepted: DataFrame, config: Config = DEFAULT, compat: bool = False) -> DataFrame:
    """seq and line of the clean export: 17 fields, or with `compat` 18 (a service tag before each coordinate) and unescaped quotes."""

    def quoted(text: Column) -> Column:
        inner = text if compat else F.replace(text, F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), inner, F.lit('"'))

    hidden = F.col("coordinates_obscured")
    fields = [F.col("id"), names.service(F.col("private_latitude"), hidden), names.valued(F.col("private_latitude"), F.col("latitude"))]
    fields += [names.service(F.col("private_longitude"), hidden)] if compat else []
    fields += [
        names.valued(F.col("private_longitude"), F.col("longitude")), F.lit(""), F.col("taxon_genus_name"), names.epithet(F.col("taxon_hybrid_name"), F.col("taxon_species_name")),
        names.last_word(F.col("taxon_subspecies_name")), names.last_word(F.col("taxon_variety_name")), F.when(F.col("taxon_hybrid_name") != "", "1").otherwise("0"),
        quoted(F.col("place_country_name")), F.replace(F.col("observed_on"), F.lit("-"), F.lit("/")), quoted(F.replace(F.col("place_guess"), F.lit('"'), F.lit(""))),
        quoted(F.col("user_login")), quoted(F.col("user_id")), F.lit("unverified"), F.when(F.col("image_url").contains(config.image_host), F.col("image_url")).otherwise(""),
    ]
    return accepted.select("seq", F.concat_ws(",", *fields).alias("line"))


def write_clean(accepted: DataFrame, folder: str, config: Config = DEFAULT, compat: bool = False, name: str = "clean.csv") -> None:
    write_document(clean_lines(accepted, config, compat).withColumnRenamed("line", "element"), folder, name, CLEAN_HEADER)
