"""Fixed values that results depend on."""

# The home region (west, south, east, north), its centre, and lengths in km.
HOME_BOX = (7.8, 54.15, 9.55, 55.12)
HOME_CENTRE = (8.9, 54.7)
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32
CLUSTER_KM = 3.0
CORE_KM = 1.0
RIVER_KM = 30.0
STRETCH_KM = 5.0
BOUNDARY_KM = 10.0
MINOR_PLACE_KM = 50.0
SEPARATION_KM = 30.0
UNPLACED_KM = 500.0
KM_PER_POINT = 200.0
ITEM_POINTS = 8
GERMAN_NAME_POINTS = 4
HINT_KM = {"place": 8.0, "island": 10.0, "large": 25.0}
ISLAND_POINTS = 40.0
VILLAGE_POINTS = 30.0

# Tag keys in order of precedence.
CLASS_KEYS = ("place", "natural", "boundary", "waterway", "landuse", "man_made", "highway", "water", "historic")
DETAIL_KEYS = ("admin_level", "type")
ITEM_KEY = "wikidata"
NAME_RANKS = {"name": 0, "name:de": 1, "official_name": 2, "name:da": 2, "short_name": 2, "alt_name": 4, "old_name": 4}
#: Tags of what an object merely also goes by.
BYNAMES = ("alt_name", "old_name")
#: Every tag of an object that is read.
KEPT_KEYS = (*CLASS_KEYS, *DETAIL_KEYS, ITEM_KEY, *NAME_RANKS)

# Classes of places.
SETTLEMENTS = ("city", "town", "village", "hamlet", "isolated_dwelling", "locality", "suburb", "neighbourhood", "borough", "quarter", "farm", "municipality")
VILLAGES = ("city", "town", "village", "hamlet")
MINOR_PLACES = ("hamlet", "isolated_dwelling", "locality", "suburb", "neighbourhood", "quarter", "farm")
WARFT_PLACES = ("isolated_dwelling", "farm", "locality", "hamlet", "village", "neighbourhood")
CORE_PLACES = ("city", "town", "village", "hamlet", "isolated_dwelling", "locality", "suburb", "neighbourhood", "farm", "polder")
ISLANDS = ("island", "islet", "archipelago")

# Circles (lon, lat, km) of hints that no object carries, and hints that are large, both in normalised form.
HINT_CIRCLES = {
    "karrharde": (9.02, 54.80, 15.0), "boekingharde": (8.85, 54.77, 15.0), "wiedingharde": (8.72, 54.88, 12.0), "beltringharde": (8.93, 54.58, 12.0),
    "boekingharde osterdeich": (8.85, 54.77, 15.0), "nordmarsch": (8.56, 54.63, 6.0), "butweel": (8.60, 54.63, 6.0), "luett moor": (8.83, 54.55, 6.0),
    "uthlande": (8.60, 54.65, 40.0), "dreiharde eck": (8.87, 54.80, 10.0), "st peter": (8.640, 54.306, 10.0), "sankt peter": (8.640, 54.306, 10.0),
}
LARGE_HINTS = ("sylt", "foehr", "amrum", "eiderstedt", "pellworm", "nordstrand", "nordfriesland", "dithmarschen", "angeln")

# How name tags, cells and references are written.
PUNCTUATION = r"[\-–—_/.'`’]+"
SUFFIX_PATTERNS = (r"^(.+?)\s*\([^()]*\)\s*$", r"^(.+?)\s+auf\s+\S.*$")
REFERENCE = r"^((node|way|relation)/[1-9][0-9]*|local/[a-z0-9]+(-[a-z0-9]+)*)$"

# Letters that matching spells out, and letters that ids fold.
SPELT_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "ø": "oe", "æ": "ae"}
FOLDED = {"ß": "ss", "æ": "ae", "Æ": "ae", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d"}
TYPE_WORDS = ("Kreis", "Amt", "Stadt", "Gemeinde", "Hallig", "Insel", "Landkreis", "Flecken")
