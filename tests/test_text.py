import unicodedata

import pytest
from pyspark.sql import functions as F

from kinforge.functions import text

# (raw, norm, clean)
NAMES = [
    ("Maure Williams Colombier Inc", "maure williams colombier incorporated", "maure williams colombier"),
    ("Urban Tech Limited", "urban technologies limited", "urban technologies"),
    ("Private Solutions Indian Designs Limited", "private solutions indian designs limited", "solutions indian designs"),
    ("Kestic Coastal L.L.C.", "kestic coastal llc", "kestic coastal"),
    ("Kestic Coastal LLC", "kestic coastal llc", "kestic coastal"),
    ("L.L.P.", "l lp", "l"),
    ("Smith & Sons' Café", "smith and sons café", "smith and sons café"),
    ("Joe’s Diner + Grill @ Main", "joe diner and grill at main", "joe diner and grill at main"),
    ("and Co", "and company", "and company"),
    ("LLC", "llc", "llc"),
    ("ＡＣＭＥ  Pvt. Ltd.", "acme private limited", "acme"),
    ("STRAẞE GmbH", "strasse gmbh", "strasse"),
    ("राम प्राइवेट लिमिटेड", "राम प्राइवेट लिमिटेड", "राम"),
    ("---", "", ""),
    ("NaN", "", ""),
    (None, "", ""),
    ("  ", "", ""),
    ("N/A", "n a", "n a"),
]

# (raw, norm, postal, street)
ADDRESSES = [
    ("85 Wayne Avenue, Ticonderoga, NY", "85 wayne avenue ticonderoga ny", None, "85"),
    ("Crown Point, IN, 787 Ronny Court", "crown point in 787 ronny court", "787", None),
    ("s/o", "south o", None, None),
    ("s.o Ram", "son of ram", None, None),
    ("H.No 5", "h number 5", None, "5"),
    ("hno 5 MG Rd", "house number 5 mg road", None, "5"),
    ("12 St. Louis St", "12 street louis street", None, "12"),
    ("Flat 402, Building 7, MG Road, Bangalore 560001", "flat 402 building 7 mg road bangalore 560001", "560001", "402"),
    ("Road 12", "road 12", None, "12"),
    ("Road 12345", "road 12345", "12345", "12345"),
    ("a b c d 12", "a b c d 12", None, "12"),
    ("मुंबई ४००००१", "मुंबई ४००००१", "४००००१", "४००००१"),
    ("<NA>", "", None, None),
    (None, "", None, None),
]


@pytest.fixture(scope="module")
def normal(spark):
    rows = [(str(i), n[0], None, None) for i, n in enumerate(NAMES)] + [(f"a{i}", None, a[0], " US ") for i, a in enumerate(ADDRESSES)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return {r["entity_id"]: r for r in text.normalize(df).collect()}


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_names(normal, i):
    raw, norm, clean = NAMES[i]
    row = normal[str(i)]
    assert (row["n_norm"], row["n_clean"], row["n_has"]) == (norm, clean, norm != "")
    assert row["n_tokens"] == norm.split()


@pytest.mark.parametrize("i", range(len(ADDRESSES)))
def test_addresses(normal, i):
    raw, norm, postal, street = ADDRESSES[i]
    row = normal[f"a{i}"]
    assert (row["a_norm"], row["a_postal"], row["a_street"], row["a_has"], row["c_norm"]) == (norm, postal, street, norm != "", "US")


def test_marks_only_keeps_raw(normal):
    assert normal[str(NAMES.index(("---", "", "")))]["n_raw"] == "---"


def test_folding_matches_python(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne", "ÀÉ", "plain ASCII", "İ", "ｆｕｌｌ", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.nfkc_casefold(F.col("w")).alias("x"), text.casefold(F.col("w")).alias("y"))
    for r in df.collect():
        assert r["x"] == unicodedata.normalize("NFKC", r["w"]).casefold()
        assert r["y"] == r["w"].casefold()


def test_reader_nulls(spark):
    df = spark.createDataFrame([("NA",), ("x",), ("",), ("null",)], "w string").select(text.reader_nulls(F.col("w")).alias("w"))
    assert [r["w"] for r in df.collect()] == [None, "x", None, None]
