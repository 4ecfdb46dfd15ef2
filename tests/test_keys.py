import pytest
from pyspark.sql import functions as F

from plinth.functions import keys, scalars, text


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "column, cases",
    [
        (keys.npi_key, {"1003038688.0": "1003038688", "1003038688.00": "1003038688", "  1003038688.0  ": "1003038688", "10030386880": "10030386880", None: None}),
        (keys.phone_key, {"11234567890": "1234567890", "123456789": None, "": None, None: None, "abc": None, "(303) 555-0100": "3035550100"}),
        (keys.phone_display, {"3035550100": "303-555-0100", "13035550100": "303-555-0100", "555": "555", None: None}),
        (keys.zip5, {"3313": "03313", "33130": "33130", "331304364": "33130", "33130.0": "33130", "33130-4364": "33130", "": None, None: None}),
        (lambda c: keys.fips(c, 5), {"1001": "01001", "1001.0": "01001", "x": None, "123456": None, None: None}),
        (keys.title_case, {"o'brien-SMITH jones": "O'Brien-Smith Jones", "": "", None: None}),
        (keys.first_last_key, {"Ann B. Lee": "ann lee", "Ann": None, None: None}),
        (keys.taxonomy_subspecialty, {"207V00000X": "Generalist", "207VX0201X": "Gynecologic Oncology", "208000000X": "Not OB-GYN", " ": "Unknown", None: "Unknown"}),
        (keys.school_origin, {"ROSS UNIVERSITY, DOMINICA": "IMG", "State University": "US/Canada", "N/A": None, None: None}),
        (keys.credential_kind, {"MD, FACOG": "physician", "NP": "mid_level", "": None, None: None}),
        (scalars.parse_flag, {"TRUE": True, " true ": True, "FALSE": False, "": False, None: False}),
        (text.slug_label, {"https://a.org/x/jane-doe/": "jane doe", "https://a.org/b_c?q=1": "b c"}),
        (text.geoid_in, {'{"GEOID": "08031000100"}': "08031000100", "{}": None}),
    ],
)
def test_table(spark, column, cases):
    assert values(spark, column, list(cases)) == list(cases.values())


def test_null_tokens(spark):
    assert values(spark, keys.is_blank, [None, "", "n/a", "NaN", "NA", " ", "x"]) == [True, True, True, True, True, False, False]
    assert values(spark, lambda c: keys.is_blank(c, (), trim=True), [None, " ", "NA"]) == [True, True, False]
    assert values(spark, lambda c: keys.is_blank(c, fold=False), ["na", "NA"]) == [False, True]


def address(spark, *streets, city="Miami", state="FL", postal="33130"):
    return values(spark, lambda c: keys.address_key(c, F.lit(city), F.lit(state), F.lit(postal)), list(streets))


def test_address_keys(spark):
    apart = address(spark, "1 FLAGLER ST", "1 FLAMINGO AVE", "1 FLORIDA BLVD", "1 NOLAN RD", "1 NORTH RD", "1 STERLING WAY")
    assert len(set(apart)) == 6 and None not in apart
    same = address(spark, "100 MAIN ST SUITE 400", "100 MAIN ST, SUITE 900", "100 Main St Ste 400", "100 MAIN ST FL 2")
    assert set(same) == {"100MAINST_MIAMI_FL_33130"}
    assert address(spark, "", None, "N/A") == [None] * 3
    assert address(spark, "1 A ST", city="N/A") == [None] and address(spark, "1 A ST", state="NAN") == [None] and address(spark, "1 A ST", postal="3313") == [None]
    assert address(spark, "1 A ST", postal="331304364") == address(spark, "1 A ST", postal="33130.0") == address(spark, "1 A ST")


def test_office_key(spark):
    got = values(spark, lambda c: keys.office_key(c, F.lit("a"), F.lit("co"), F.lit("1234"), F.lit("own")), ["10 Oak Street Suite 5 Rear", "10 OAK ST", "", None])
    assert got == ["10 OAK ST | A | CO | 01234"] * 2 + ["own"] * 2


def test_names(spark):
    got = values(spark, keys.parse_name, ["Dr. Ann B. Lee Jr, MD, FACOG", "Ann Lee DO", "Cher", "", None])
    assert [tuple(g) for g in got] == [("Dr.", "Ann", "B.", "Lee Jr", "MD, FACOG"), ("", "Ann", "", "Lee", "DO"), ("", "Cher", "", "", ""), ("", "", "", "", ""), ("", "", "", "", "")]
    assert values(spark, keys.board_tokens, ["Lee A. Ann MD", "A B"]) == [["LEE", "ANN"], None]
    assert values(spark, lambda c: keys.md_or_do(c, identified=F.lit(False)), ["A, D.O.", "A MD", "A"]) == ["DO", "MD", None]


def test_settings(spark):
    f = lambda words: values(spark, lambda c: keys.practice_setting(c, whole_words=words), ["NEVADA WOMEN", "UNIVERSITY OF X", "X ARMY HOSPITAL", "A LLC", None])
    assert f(True) == ["Unknown", "Academic", "Military", "Private Practice", "Unknown"]
    assert f(False)[0] == "Government"  # VA inside a word


def test_text(spark):
    assert values(spark, text.strip_tags, ["<p>a <b>b</b><br/>c</p>"]) == ["a b\nc"]
    assert values(spark, lambda c: text.strip_tags(c, True), ["x &amp; y"]) == ["x & y"]
    assert values(spark, text.tidy_address, ["1 A St\n\nDenver , CO,"]) == ["1 A St, Denver, CO"]
    assert values(spark, text.state_in, ["9 Elm, Denver, CO 80202", "none"]) == ["CO", None]
    assert values(spark, text.city_in, ["9 Elm, Denver, CO 80202", "none"]) == ["Denver", None]
    assert tuple(values(spark, text.locality, ["9 Elm<br>Floor 2<br>Denver, CO 80202"])[0]) == ("9 Elm, Floor 2", "Denver", "CO", "80202")
    assert values(spark, text.citation_keys, ["see [@lee2020; @kim:2] a@b.org"]) == [["lee2020", "kim:2"]]
    assert values(spark, text.scales, ["OR [0.26] IRR [1]"]) == [{"OR": "0.26", "IRR": "1"}]
    assert tuple(values(spark, text.parse_choice, ["7, id: 12, Ann Lee, Denver, CO, Phone 303"])[0]) == ("7", "12", "Ann Lee", "Denver", "CO", "303")
    assert values(spark, lambda c: text.balanced_segment(c, "data ="), ['data = {"a": "}", "b": [1]} tail', "none", 'data = {"a"', None]) == ['{"a": "}", "b": [1]}', None, None, None]
    assert values(spark, lambda c: text.links(c, 2, ["about"]), ['<a href="/x/y">1</a><a href="/x">2</a><a href="/about/z">3</a><a href="/x/y#q">4</a>']) == [["/x/y"]]
    assert values(spark, lambda c: text.p_value(c.cast("double")), ["0.0001", "0.0455"]) == ["<0.001", "0.046"]
    assert values(spark, lambda c: text.percent(c.cast("double")), ["0.125"]) == ["12.5%"]


def test_scalars(spark):
    assert [tuple(x) for x in values(spark, lambda c: scalars.decode_transfers(c.cast("int")), ["1", "2", "3", "4", None])] == [(0, False), (1, False), (2, False), (3, True), (None, False)]
    with pytest.raises(Exception, match="outside 1 to 4"):
        values(spark, lambda c: scalars.decode_transfers(c.cast("int")), ["5"])
    assert values(spark, scalars.usable_number, ["1", "0", "x", "NaN", "Infinity", None]) == [True, False, False, False, False, False]
    assert round(values(spark, lambda c: scalars.dispersion(F.lit(20.0), c.cast("double")), ["8"])[0], 3) == round(400 / 44, 3)
    assert values(spark, lambda c: scalars.censored(c.cast("int"), F.lit(True), 30), ["4", "40"]) == [4, 31]
