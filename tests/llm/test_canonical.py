import random

from pyspark.sql import functions as F

from millrace.llm import canonical as c

REGIONS = [("NV", "Norvale", ()), ("HW", "Harrowmere", ()), ("NH", "North Harrowmere", ()), ("SH", "South Harrowmere", ()), ("OL", "Old Lanthorn", ()), ("NL", "New Lanthorn", ()), ("ÖS", "Östermark", ()), ("LT", "Lower Tarsis", ())]
SKILLS = [("1", "route planning", ("dispatch mapping",)), ("46", "container orchestration", ("c12n",)), ("18", "welding", ()), ("71", "quillbase", ("qbase", "qb"))]


def distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_regions():
    f = c.Canonicalizer(REGIONS, True).find
    for value, key in {"nv": "NV", "N.V.": "NV", "State of Norvale": "NV", "Norvale (state)": "NV", "NV - Norvale": "NV", "Norvale, Ardenia": "NV", "Nrovale": "NV", "N. Lanthorn": "NL", "O Lanthorn": "OL",
                       "S Harrowmere": "SH", "North-Harrowmere": "NH", "  Harrowmere": "HW", "Ostermark": "ÖS", "ös": "ÖS", "Lwr. Tarsis": "LT", "Hexby, NL": "NL", "Zone 4": "", "remote": "", "n/a": "", "Ketterstrand": ""}.items():
        assert f(value)[0] == key, value


def test_skills():
    f = c.Canonicalizer(SKILLS).find
    for value, key in {"Route Planning": "1", "planning, route": "1", "routeplanning": "1", "route_planning": "1", "DISPATCH MAPPING": "1", "3+ years route planning": "1", "experience in route planning": "1",
                       "- route planning.": "1", "route planning (advanced)": "1", "Route Pllnning": "1", "c12n": "46", "C12N": "46", "weldnig": "18", "QB": "71", "qa": "", "grit": "", "": "", "house style 9": ""}.items():
        assert f(value)[0] == key, value


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    finder = c.Canonicalizer([(n, n, ()) for n in set(names)])
    for _ in range(200):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
        for limit in (1, 2):
            want = sorted((distance(q, n), n) for n in set(names) if distance(q, n) <= limit)
            assert finder.near(q, limit) == want


def test_equally_near_entries_mean_none():
    finder = c.Canonicalizer([("a", "abcdefg", ()), ("b", "abcdefh", ()), ("c", "abcdexyz", ("qrs",)), ("d", "other", ("qrs", "abcdefg"))])
    assert finder.find("abcdefx") == ("", -2, [("a", 1), ("b", 1), ("d", 1)])
    assert finder.find("qrs") == ("", -2, [("c", 0), ("d", 0)])  # an other name of two entries
    assert finder.find("abcdefg") == ("a", 0, [("a", 0)])  # a name is stronger than an other name
    assert finder.find("zzzzzzzz") == ("", -1, [])


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "Norvale", "x"), (1, "Norvale", "x"), (2, None, "y"), (3, "", "z"), (4, "q" * 100_000, "z")], "ref_key int, v string, edits string")
    got = sorted((r.v or "", r.ref_key) for r in c.canonicalize(df, "v", REGIONS, True).collect())
    assert got[:2] == [("", ""), ("", "")] and ("Norvale", "NV") in got and len(got) == 5
    listed = {r.v: (r.as_listed, r.edits) for r in c.canonicalize(df, "v", REGIONS).collect()}
    assert listed["Norvale"] == (True, 0) and listed[""] == (False, -1) and listed[None] == (False, -1)
    assert c.canonicalize(df.limit(0), "v", REGIONS).count() == 0
    mapped = c.canonicalize(df.withColumnRenamed("ref_key", "n"), "v", REGIONS, True)
    assert c.unmatched_report(mapped.filter(F.length("v") > 9), "v").first().n == 1
