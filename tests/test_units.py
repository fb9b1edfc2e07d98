import pytest

from millrace.operators import units

PHYSICAL = units.UnitGrammar(
    roots={"length": {"m": "metre", "metre": "metre", "metres": "metre", "in": "inch"}, "mass": {"g": "gram"}, "time": {"s": "second", "h": "hour", "m": "minute", "min": "minute"}, "power": {"W": "watt"}},
    scales={}, divided=(), prefixes=units.PREFIXES, priors={"distance": {"length": -0.5}, "duration": {"time": -0.5}})
FACTORS = {"metre": 1.0, "inch": 0.0254, "gram": 1e-3, "second": 1.0, "hour": 3600.0, "minute": 60.0, "watt": 1.0}


@pytest.mark.parametrize("text, name, amount, powers", [
    ("3 mm", "distance", 0.003, {"length": 1}), ("5 kg", "mass", 5.0, {"mass": 1}), ("72 km/h", "distance", 20.0, {"length": 1, "time": -1}), ("9.81 m/s^2", "distance", 9.81, {"length": 1, "time": -2}),
    ("9.81 m s-2", "distance", 9.81, {"length": 1, "time": -2}), ("1.5 kWh", "energy", 5.4e6, {"power": 1, "time": 1}), ("12 m²", "distance", 12.0, {"length": 2}), ("250 cm2", "distance", 0.025, {"length": 2}),
    ("5 m", "distance", 5.0, {"length": 1}), ("5 m", "duration", 300.0, {"time": 1}), ("about 2 kilometres", "distance", 2000.0, {"length": 1}), ("4 in", "distance", 0.1016, {"length": 1}),
    ("7 min", "duration", 420.0, {"time": 1}), ("3 ms", "duration", 0.003, {"time": 1}), ("no number", "distance", None, {}), ("", "distance", None, {})])
def test_prefixes_roots_and_powers(text, name, amount, powers):
    got, shape = units.UnitParser(PHYSICAL).quantity(text, name, FACTORS)
    assert shape == powers and (got is None if amount is None else abs(got - amount) < 1e-9 * max(1, amount))


def test_a_sign_that_is_no_number():
    parser = units.UnitParser(units.PAY)
    assert parser.read("we are #1: $50,000 a year", "text")[1] == {"currency": "USD", "period": "yearly"}
    assert parser.read("# #  $50,000 a year", "text") == (50_000.0, {"currency": "USD", "period": "yearly"})
    assert parser.read("#", "text") == (None, {}) and parser.read("12 lpa ₹", "text") == (12e5, {"currency": "INR", "period": "yearly"})


def test_to_base_units(spark):
    df = spark.createDataFrame([(1, "3 mm", 7), (1, "3 mm", 7), (2, None, 7), (3, "", 7), (4, "x" * 50_000 + " 5 km/h", 7)], "k int, t string, id int")
    got = sorted((r.id, r.amount and round(r.amount, 6), r.dimensions) for r in units.to_base_units(df, id_col="k", text="t", name="distance", grammar=PHYSICAL, factors=FACTORS).collect())
    assert got == [(1, 0.003, "length"), (1, 0.003, "length"), (2, None, ""), (3, None, ""), (4, 1.388889, "length time^-1")]
    assert units.to_base_units(df.limit(0), id_col="k", text="t", name="x", grammar=PHYSICAL, factors=FACTORS).count() == 0
