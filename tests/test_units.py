"""Units: brute-force tables, edge rows and hot sources."""

import pytest

from tallyloom.operators import units as U


@pytest.mark.parametrize(
    "s,asked,unit",
    [("cms", "length", "cm"), ("ms", "time", "ms"), ("ms", "length", "m"), ("min", "time", "min"), ("sq. ft.", "area", "ft2"), ("m^2", "area", "m2"), ("㎡", None, "m2"), ("minute(s)", "time", "min"), ("Zentimetern", "length", "cm"), ("Quadratmetern", "area", "m2"), ("′", "length", "ft"), ("′", "time", "min"), ("″", "length", "in"), ("MM", "length", "mm"), ("km", "length", "km"), ("chairs", "length", None), ("", None, None), ("square seconds", "area", None)],
)
def test_segment(s, asked, unit):
    got = U.segment(s, asked)
    assert (got and got[0]) == unit


@pytest.mark.parametrize(
    "s,expected",
    [
        ("2 ft 5 in", [(2.0, "ft"), (5.0, "in")]), ("13'5\"", [(13.0, "ft"), (5.0, "in")]), ("3m28cm", [(3.0, "m"), (28.0, "cm")]), ("577,800 cm2", [(577800.0, "cm2")]), ("9,5", [(9.5, None)]),
        ("16 1/2 m", [(16.5, "m")]), ("2¾ metres", [(2.75, "m")]), ("1.91e2 cm", [(191.0, "cm")]), ("two and a half yards", [(2.5, "yd")]), ("approx. two", [(2.0, None)]),
        ("<think>a tile is 60 cm</think><answer>4 m</answer>", [(4.0, "m")]), ("<think>60 cm", []), ("My estimate is 5 ft, since the 3 chairs give the scale.", [(5.0, "ft")]),
        ("I have to pass on this one.", []), ("", []), (None, []), ("26'2\"", [(26.0, "ft"), (2.0, "in")]),
    ],
)
def test_quantities(s, expected):
    assert [(v, r and r[0]) for v, r in U.quantities(s, "length")] == expected


def test_notes():
    assert U.note_units("typed in as inches; areas sq ft; timings in minutes.") == {"length": "in", "area": "ft2", "time": "min"}
    assert U.note_units("Längen in Zentimetern, Flächen in Quadratmetern, Zeiten in Sekunden.") == {"length": "cm", "area": "m2", "time": "s"}
    assert U.note_units(None) == {} == U.note_units("")


def test_convert(spark):
    rows = [
        ("t", 1, "f", "tape", "How tall is the lamp?", "6", "x"), ("t", 1, "f", "tape", "How tall is the lamp?", "6", "y"),
        ("t", 2, "f", "tape", "How tall is the lamp in cm?", "60", None), ("t", 3, "f", None, "How tall is the lamp?", "60", None), ("t", 4, "f", "tape", "How tall is the lamp?", "2 m", None),
        ("t", 5, "f", "tape", "How many lamps are there?", "2 ft", None), ("t", 6, "f", "tape", None, "2 ft", None), ("t", 7, "f", "tape", "How tall?", None, None), ("t", 8, "f", "tape", "How tall?", "", None), ("t", None, "f", "tape", "How tall?", "1 ft", None),
        ("t", 9, "f", "tape", "How tall is it?", "word " * 20_000 + "7 ft", None),
    ]
    df = spark.createDataFrame(rows, "tab string, row_id bigint, field string, source string, question string, text string, note string")
    notes = spark.createDataFrame([("tape", "lengths in feet"), ("tape", "lengths in feet"), (None, "cm")], "source string, note string")
    got = {(r.row_id, r.unit): (r.unit_from, r.common_value and round(r.common_value, 4)) for r in U.convert_values(df, notes).collect()}
    assert got == {(1, "ft"): ("note", 1.8288), (2, "cm"): ("question", 0.6), (3, None): (None, None), (4, "m"): ("value", 2.0), (9, "ft"): ("value", 2.1336)}
    assert U.convert_values(df.limit(0), notes).count() == 0 and U.convert_values(df, notes.limit(0)).where("row_id = 1 and unit is null").count() == 1


def test_hot_source(spark):
    df = spark.range(3000).selectExpr("'t' tab", "id row_id", "'f' field", "case when id % 3 = 0 then 'hot' else concat('s', id) end source", "'How tall is it?' question", "cast(id as string) text")
    notes = spark.createDataFrame([("hot", "in cm")], "source string, note string")
    assert U.convert_values(df, notes).where("unit = 'cm'").count() == 1000


def test_ambiguous_units_follow_the_field(spark):
    q = "For how long is the lamp seen?"
    rows = [(f, i, f, None, q, v) for f, v in (("tapes", "7 ft"), ("clocks", "7 min")) for i in range(200)] + [(f, 1000, f, None, q, "5′") for f in ("tapes", "clocks", "new")]
    df = spark.createDataFrame(rows, "tab string, row_id bigint, field string, source string, question string, text string")
    notes = spark.createDataFrame([], "source string, note string")
    got = {r.field: (r.unit, r.common_value) for r in U.convert_values(df, notes).where("row_id = 1000").collect()}
    assert got == {"tapes": ("ft", pytest.approx(1.524)), "clocks": ("min", 300.0), "new": ("min", 300.0)}


def brute_readings(text):
    """Every way to put one entry of each layer together."""
    import itertools

    layers = [[*x, ("", None, 0.0)] for x in (U.QUALIFIERS, U.PREFIXES)] + [U.ROOTS] + [[*x, ("", None, 0.0)] for x in (U.PLURALS, U.EXPONENTS)]
    best = {}
    for combo in itertools.product(*layers):
        if "".join(c[0] for c in combo) == text and (r := U._reading(tuple(c[1] for c in combo))):
            score = sum(c[2] for c in combo)
            if r[1] not in best or score > best[r[1]][0]:
                best[r[1]] = score, r
    return best


@pytest.mark.parametrize("s", ["ms", "m", "mm", "min", "s", "sqft", "′", "″", "square metres2", "cm2", "hs", "dm", "inches", "mins"])
def test_readings_against_brute_force(s):
    got, expected = U.readings(s), brute_readings(s)
    assert {d: (pytest.approx(x), r) for d, (x, r) in got.items()} == expected


def test_unit_strings_of_any_length():
    assert U.readings("x" * 5000) == {} and U.readings("square millimeter(s)" + " " * 40)["area"][1][0] == "mm2"
