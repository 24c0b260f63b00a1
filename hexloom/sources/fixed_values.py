"""Values that must equal the published data contract."""

# The genus text that counts as missing.
MISSING_GENUS = "unbekannt"

# Source tags of the unified point table.
POINT_SOURCES = ("strassenbaeume", "anlagenbaeume", "gruen_berlin")

# Source catalogue (key, geometry type, coordinate system, licence).
SOURCE_CATALOGUE = (
    ("alkis_ortsteile", "Polygon", "EPSG:25833", "dl-de/zero-2-0"),
    ("baumbestand_anlagen", "Point", "EPSG:25833", "dl-de/zero-2-0"),
    ("baumbestand_strassen", "Point", "EPSG:25833", "dl-de/zero-2-0"),
    ("gruen_berlin", "Point", "EPSG:25833", "dl-de/by-2-0"),
    ("forstbetriebskarte", "Polygon", "EPSG:25833", "dl-de/zero-2-0"),
)

# District code to district name.
DISTRICT_NAMES = {
    "01": "Mitte",
    "02": "Friedrichshain-Kreuzberg",
    "03": "Pankow",
    "04": "Charlottenburg-Wilmersdorf",
    "05": "Spandau",
    "06": "Steglitz-Zehlendorf",
    "07": "Tempelhof-Schöneberg",
    "08": "Neukölln",
    "09": "Treptow-Köpenick",
    "10": "Marzahn-Hellersdorf",
    "11": "Lichtenberg",
    "12": "Reinickendorf",
}

# Columns kept when single points are exported.
POINT_EXPORT_COLUMNS = (
    "tree_uuid",
    "species_latin",
    "species_german",
    "genus_latin",
    "planting_year",
    "tree_age",
    "source",
)

# Which archive each exported layer belongs to.
LAYER_ARCHIVES = {
    "h3_res6": "res6",
    "h3_res6_centroids": "res6",
    "h3_res7": "res7",
    "h3_res7_centroids": "res7",
    "h3_res8": "res8",
    "h3_res8_centroids": "res8",
    "h3_res9": "res9",
    "h3_res9_centroids": "res9",
    "admin_bezirke": "admin",
    "admin_bezirke_centroids": "admin",
    "admin_ortsteile": "admin",
    "admin_ortsteile_centroids": "admin",
    "berlin_border": "admin",
    "agg_berlin": "admin",
    "forests": "forests",
    "forests_union": "forests",
    "trees": "trees",
}

# First and last zoom of the layers; single points start later.
LAYER_ZOOMS = (4, 17)
POINT_ZOOMS = (6, 17)

# Stand code, German name, genus ('' where no genus can be named).
STAND_CODES = (
    ("GKI", "Gemeine Kiefer", "Pinus"),
    ("GBI", "Gemeine Birke", "Betula"),
    ("Ei", "Eiche", "Quercus"),
    ("TEI", "Traubeneiche", "Quercus"),
    ("ELA", "Europäische Lärche", "Larix"),
    ("RBU", "Rotbuche", "Fagus"),
    ("REI", "Roteiche", "Quercus"),
    ("RO", "Robinie", "Robinia"),
    ("SEI", "Stieleiche", "Quercus"),
    ("RER", "Roterle", "Alnus"),
    ("BAH", "Bergahorn", "Acer"),
    ("DGS", "Douglasie", "Pseudotsuga"),
    ("SAH", "Spitzahorn", "Acer"),
    ("WLI", "Winterlinde", "Tilia"),
    ("PAS", "Pappel", "Populus"),
    ("BPA", "Balsampappel", "Populus"),
    ("GES", "Gemeine Esche", "Fraxinus"),
    ("EAH", "Eschenblättriger Ahorn", "Acer"),
    ("WKI", "Weymouthskiefer", "Pinus"),
    ("GFI", "Gemeine Fichte", "Picea"),
    ("HBU", "Hainbuche", "Carpinus"),
    ("AS", "Aspe", "Populus"),
    ("Blö", "Blöße", ""),
    ("SBW", "Baumweiden", "Salix"),
    ("STK", "Spätblühende Traubenkirsche", "Prunus"),
    ("JLA", "Japanische Lärche", "Larix"),
    ("GPA", "Graupappel", "Populus"),
    ("WRU", "Flatterrüster", "Ulmus"),
    ("BRU", "Bergrüster", "Ulmus"),
    ("VKB", "Vogelkirsche", "Prunus"),
    ("WER", "Grauerle", "Alnus"),
    ("EB", "Eberesche", "Sorbus"),
    ("FIS", "sonstige Fichten", "Picea"),
    ("BWE", "Bruchweide", "Salix"),
    ("ESS", "Esche", "Fraxinus"),
    ("SKI", "Schwarzkiefer", "Pinus"),
    ("RKA", "Roßkastanie", "Aesculus"),
    ("SLI", "Sommerlinde", "Tilia"),
    ("FAH", "Feldahorn", "Acer"),
    ("KTA", "Küstentanne", "Abies"),
    ("BIS", "Birke", "Betula"),
    ("AHS", "Ahorn", "Acer"),
    ("KIS", "sonstige Kiefern", "Pinus"),
    ("NHS", "Sonstige Nadelbaumarten", ""),
    ("EIS", "sonstige Eichen", "Quercus"),
    ("RUS", "Rüster", "Ulmus"),
    ("MEH", "Mehlbeere", "Sorbus"),
    ("SPE", "Speierling", "Sorbus"),
    ("SPA", "Europäische Schwarzpappel", "Populus"),
    ("MBI", "Moorbirke", "Betula"),
    ("EIB", "Eibe", "Taxus"),
    ("WWE", "Silberweide", "Salix"),
    ("ELS", "Elsbeere", "Sorbus"),
)
