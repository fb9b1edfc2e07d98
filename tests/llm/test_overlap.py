import random

from pyspark.sql import functions as F

from millrace.llm import overlap

WORDS = [f"w{i}" for i in range(400)]


def brute(a, b, k=5, least=0.6):
    out = set()
    for i, s in a:
        for j, t in b:
            if i is None or j is None or not s or not t:
                continue
            x, y = overlap.runs_of(s, k), overlap.runs_of(t, k)
            if (x or y) and len(x & y) / len(x | y) >= least:
                out.add((i, j))
    return out


def make(seed, n=60):
    rng = random.Random(seed)
    stock = " ".join(rng.choices(WORDS, k=25))
    a, b = [], []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randint(40, 120))
        a.append((f"a{i}", " ".join(w) + " " + stock))
        if i % 3 == 0:
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 14))):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            b.append((f"b{i}", " ".join(v).upper() + ",\n" + stock))
        else:
            b.append((f"b{i}", " ".join(rng.choices(WORDS, k=80)) + " " + stock))
    return a, b


def test_equals_brute_force(spark):
    for seed in (1, 2):
        a, b = make(seed)
        got = {(r.id_a, r.id_b) for r in overlap.overlaps(spark.createDataFrame(a, "id string, text string"), spark.createDataFrame(b, "id string, text string"), "id", "text").collect()}
        assert got == brute(a, b)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    a = [("1", "one two three four five six seven"), ("1", "one two three four five six seven"), ("2", None), ("3", ""), (None, "one two three four five six seven"), ("4", "too short"), ("5", long)]
    b = [("9", "One, two; three four five six SEVEN"), ("8", "too short"), ("7", long + " end"), ("6", None)]
    shape = "cls string, text string, segment int, id_a int"
    x = spark.createDataFrame([(*r, 1, 2) for r in a], shape)
    y = spark.createDataFrame([(*r, 1, 2) for r in b], shape)
    got = sorted((r.id_a, r.id_b, round(r.similarity, 3)) for r in overlap.overlaps(x, y, "cls", "text").collect())
    assert got == [("1", "9", 1.0), ("5", "7", 1.0)]
    assert overlap.overlaps(x.limit(0), y, "cls", "text").count() == 0
    assert overlap.overlaps(x.limit(0), y.limit(0), "cls", "text").count() == 0


def test_copies_are_one_class(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    a = spark.range(500).select(F.col("id").cast("string"), F.lit(text).alias("t"))
    b = spark.createDataFrame([("x", text)], "id string, t string")
    assert overlap.class_links(a, b, "t").count() == 1
    assert overlap.overlaps(a, b, "id", "t").count() == 500


def test_report(spark):
    b = spark.createDataFrame([("1", "val", "s"), ("2", "val", "s"), ("3", "test", None)], "id string, split string, source string")
    pairs = spark.createDataFrame([("x", "1", 1.0), ("y", "1", 0.7)], "id_a string, id_b string, similarity double")
    got = {(r.split, r.source): (r.n_records, r.n_leaked, r.n_pairs, r.n_same) for r in overlap.overlap_report(pairs, b, "id", "split", "source").collect()}
    assert got == {("val", "s"): (2, 1, 2, 1), ("test", None): (1, 0, 0, 0)}


def test_near_copies_of_a_third_of_the_rows(spark):
    """All runs that such pairs share are held by very many texts."""
    rng = random.Random(7)
    base = [f"base{i}" for i in range(200)]

    def side(name):
        out = [(f"{name}-same", " ".join(base))]
        for i in range(39):
            v = list(base)
            for at in range(i % 20 + 5, 200, 48):
                v[at] = f"{name}{i}x{at}"
            out.append((f"{name}{i}", " ".join(v)))
        # half stock, and the other half shared in part
        half = [f"own{j}" for j in range(90)]
        for i in range(6):
            own = [f"{name}{i}y{j}" if j % 30 == 7 + i else w for j, w in enumerate(half)]
            out.append((f"{name}-half{i}", " ".join(base[:100] + own)))
        return out + [(f"{name}-other{i}", " ".join(rng.choices(WORDS, k=80))) for i in range(80)]

    a, b = side("a"), side("b")
    want = brute(a, b)
    shape = "id string, text string"
    got = {(r.id_a, r.id_b) for r in overlap.overlaps(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), "id", "text").collect()}
    assert len(want) > 1500 and got == want


def test_recall_where_texts_are_mostly_common_sentences(spark):
    """Templates that over 0.2 % of the texts hold, with own words in all proportions, among many other texts."""
    rng = random.Random(11)
    many = [f"v{i}" for i in range(5000)]
    templates = [rng.choices(many, k=n) for n in (190, 120, 60)]

    def own(base, n, changed):
        words = rng.choices(many, k=n) if base is None else list(base)
        for at in rng.sample(range(len(words)), min(changed, len(words))):
            words[at] = rng.choice(many)
        return words

    a, b = [], []
    for t, template in enumerate(templates):
        for n in (5, 21, 40, 80, 150):
            base = rng.choices(many, k=n)
            for i in range(15):
                a.append((f"a{t}-{n}-{i}", " ".join(template + own(None if i % 2 else base, n, n // 12))))
            for i in range(6):
                b.append((f"b{t}-{n}-{i}", " ".join(template + own(None if i % 2 else base, n, n // 8))))
    a += [(f"ao{i}", " ".join(rng.choices(many, k=rng.randint(60, 200)))) for i in range(2000)]
    b += [(f"bo{i}", " ".join(rng.choices(many, k=rng.randint(60, 200)))) for i in range(600)]
    runs_a, runs_b = ({i: overlap.runs_of(x, 5) for i, x in side} for side in (a, b))
    want = set()
    for i, x in runs_a.items():
        for j, y in runs_b.items():
            if i.startswith("ao") or j.startswith("bo"):
                continue
            if len(x & y) / len(x | y) >= 0.6:
                want.add((i, j))
    shape = "id string, text string"
    found = overlap.overlaps(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), "id", "text").collect()
    got = {(r.id_a, r.id_b) for r in found}
    assert len(want) > 500 and got <= want
    assert len(got) / len(want) >= 0.97, (len(got), len(want))
