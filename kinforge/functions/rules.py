"""Rules of normalization and key building, as data."""

from __future__ import annotations

# Fixed values. Order matters: rules are applied one after the other.

#: (words, replacement) of legal forms in names.
LEGAL_SUFFIXES = (
    (("pvt", "pte", "pvtltd"), "private"),
    (("ltd",), "limited"),
    (("inc", "incorp"), "incorporated"),
    (("corp",), "corporation"),
    (("co",), "company"),
    (("llc",), "llc"),
    (("llp",), "llp"),
    (("lp",), "lp"),
    (("pllc",), "pllc"),
    (("sarl",), "sarl"),
    (("sas",), "sas"),
    (("sasu",), "sasu"),
    (("sa",), "sa"),
    (("eurl",), "eurl"),
    (("snc",), "snc"),
    (("sci",), "sci"),
    (("gmbh",), "gmbh"),
    (("cie",), "company"),
)

#: (words, replacement) of generic abbreviations in names.
GENERIC_ABBREVIATIONS = (
    (("ent",), "enterprises"),
    (("ind",), "industries"),
    (("intl",), "international"),
    (("mfg",), "manufacturing"),
    (("svcs",), "services"),
    (("tech",), "technologies"),
    (("assn", "assoc"), "associates"),
    (("dept",), "department"),
    (("grp",), "group"),
    (("soln", "solns"), "solutions"),
)

#: Tokens dropped from the clean name.
SUFFIX_TOKENS = (
    "private", "limited", "incorporated", "corporation", "company", "llc", "llp", "lp", "pllc", "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "gmbh",
    "प्राइवेट", "लिमिटेड", "कंपनी", "प्रा", "लि", "pvt", "ltd", "inc", "corp", "co",
)

#: Phrases dropped from the clean name before its tokens; the last has no word boundaries.
SUFFIX_PHRASES = ("private limited", "limited liability company", "limited liability partnership", "limited partnership")
SUFFIX_PHRASES_ANYWHERE = ("प्राइवेट लिमिटेड",)

#: (patterns between word boundaries, replacement) of abbreviations in addresses.
ADDRESS_ABBREVIATIONS = (
    (("rd",), "road"),
    (("st", "str"), "street"),
    (("ave", "av"), "avenue"),
    (("blvd", "bld"), "boulevard"),
    (("dr",), "drive"),
    (("ln",), "lane"),
    (("ct",), "court"),
    (("pl",), "place"),
    (("pkwy",), "parkway"),
    (("hwy",), "highway"),
    (("expy",), "expressway"),
    (("fwy",), "freeway"),
    (("cir",), "circle"),
    (("trl",), "trail"),
    (("sq",), "square"),
    (("plz",), "plaza"),
    (("che",), "chemin"),
    (("all",), "allee"),
    (("imp",), "impasse"),
    (("rte",), "route"),
    (("crs",), "cours"),
    (("apt",), "apartment"),
    (("ste",), "suite"),
    (("bldg",), "building"),
    (("fl", "flr"), "floor"),
    (("rm",), "room"),
    (("sec",), "sector"),
    (("soc",), "society"),
    (("col",), "colony"),
    (("res",), "residence"),
    (("bat",), "batiment"),
    (("opp",), "opposite"),
    (("nr",), "near"),
    (("dist",), "district"),
    (("tq",), "taluk"),
    (("po",), "post office"),
    (("no",), "number"),
    ((r"h[.\s/]*no",), "house number"),
    ((r"b[./]h",), "behind"),
    ((r"c[./]o",), "care of"),
    ((r"w[./]o",), "wife of"),
    ((r"s[./]o",), "son of"),
    ((r"d[./]o",), "daughter of"),
    (("n",), "north"),
    (("s",), "south"),
    (("e",), "east"),
    (("w",), "west"),
    (("ne",), "northeast"),
    (("nw",), "northwest"),
    (("se",), "southeast"),
    (("sw",), "southwest"),
)

#: Address words that make no blocking key.
ADDRESS_STOPWORDS = (
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "highway", "hwy", "boulevard", "blvd", "court", "ct", "place", "pl",
    "floor", "fl", "flr", "suite", "ste", "apartment", "apt", "room", "rm", "building", "bldg", "near", "nr", "opp", "opposite", "behind", "next",
    "route", "rte", "chemin", "che", "rue", "allee", "all", "cours", "crs",
)

#: Domain endings deleted from names before their blocking keys.
DOMAINS = ("com", "in", "org", "net", r"co\.in", "co", "io", "biz", "info", "fr")

#: Values that mean "missing", after trimming and lower-casing.
MISSING = ("", "nan", "null", "none", "<na>")
#: The narrower list for the address keys.
MISSING_ADDRESS_KEYS = ("", "nan", "null", "none")
#: What a common table reader turns into missing values besides.
READER_NA = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Soundex digits by letter.
SOUNDEX = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}

#: Base rates of countries (lower case), and of any other.
COUNTRY_RATES = {"us": 0.60, "in": 0.40, "india": 0.40, "united states": 0.60}
OTHER_COUNTRY_RATE = 0.15

#: Weights of blocking keys: added to the key's idf, or fixed.
IDF_BONUS = {"bigram": 1.5, "post_name_": 4.0, "post_num_": 4.0, "ash_": 3.0, "st_num_word": 3.0}
FIXED_WEIGHT = {"char_ngrams": 2.0, "phonetic": 1.5}
#: Longest posting list that a key may have, by strategy.
POSTING_CAPS = {"name_tokens": 3000, "char_ngrams": 3000, "phonetic": 3000, "address": 1000}
STRATEGIES = ("name_tokens", "char_ngrams", "phonetic", "address")
