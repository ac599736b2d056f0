import random

from pyspark.sql import functions as F

from casegraph.functions import names, scores


def column(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(fn(F.col("x"))).collect()]


def test_normalise(spark):
    assert column(spark, names.normalise_latin, ["Ravi  Kumar", "a b   Kumar", "A B C Devi", " x Bai", "Dr. X Y", "mr Late Z Reddy"]) == ["ravi kumar", "a b", "a b c", "x bai", "dr x y", "late z"]
    raw = ["Mr Ramesh", "Ramesh-Kumar_123", "रमेश कुमार", "ರಮೇಶ ಕುಮಾರ", "Kumar", "Smt Lakshmi Devi Bai", "", None]
    assert column(spark, names.normalise_name, raw) == ["ramesh", "rameshkumar", "ramesh kumar", "ramesh kumar", "kumar", "lakshmi devi", "", ""]


def test_transliterate(spark):
    raw = ["ಕ್ಕ", "ಕೊ", "ಕೊ", "ಕೋ", "ರಾಮಂ", "ಃ", "ಾ", "್", "किx", "ét", "Ravi", "कं", "दुःख", ""]
    assert column(spark, names.transliterate, raw) == ["kk", "ko", "ko", "ko", "ramam", "h", "a", "", "kix", "\u0301t", "Ravi", "kam", "duhkh", ""]


def test_soundex(spark):
    assert column(spark, names.soundex_name, ["Ramesh", "Ramash", "Rajesh", "Kumar", "Ramesh Kumar", "mama", ""]) == ["R520", "R520", "R200", "K560", "R520 K560", "M000", ""]


def test_metaphone(spark):
    given = {"Ramesh": "RMX", "Rajesh": "RJX", "Kumar": "KMR", "Shiva": "XF", "Thakur": "TKR", "Tanvi Thakur": "TNF TKR", "Vishal": "FXL", "Waseem": "FSM", "Khan": "KN", "Ghanshyam": "KNXM", "Chandra": "XNJR"}
    assert column(spark, names.metaphone_name, list(given)) == list(given.values())
    assert column(spark, names.phonetic_key, ["Ramesh", "  ", None]) == ["R520 RMX", "", ""]


def test_other_keys(spark):
    assert column(spark, names.last_word_key, ["Ramesh Kumar", "x", ""]) == ["K560 KMR", column(spark, names.phonetic_key, ["x"])[0], ""]
    assert column(spark, names.initial_surname_key, ["ramesh kumar", "kumar", ""]) == ["r K560", "", ""]
    assert column(spark, lambda c: names.surname_age_key(c, F.lit(33)), ["ramesh kumar", "kumar"]) == ["kumar 6", ""]
    assert column(spark, names.spelling_variants, ["anna rao"]) == [["anna rao", "a rao", "rao anna", "ana rao", "ann r"]]


def plain_jaro_winkler(a, b):
    """Letter by letter, with lists."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free, pairs = list(b), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] == x), None)
        if j is not None:
            free[j] = None
            pairs.append((i, j))
    if not pairs:
        return 0.0
    moved = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True))
    n = len(pairs)
    jaro = (n / len(a) + n / len(b) + (n - moved / 2) / n) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def plain_name_score(a, b):
    ta, tb = a.split(), b.split()
    base = max(plain_jaro_winkler(a, b), plain_jaro_winkler(" ".join(sorted(ta)), " ".join(sorted(tb))))
    if len(ta) > 1 and len(tb) > 1 and ta[0] == tb[0] and ta[-1] != tb[-1]:
        last = plain_jaro_winkler(ta[-1], tb[-1])
        base *= 0.65 if last < 0.6 else 0.8 if last < 0.8 else 1.0
    return min(base, 1.0)


def test_similarity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    name = lambda: " ".join(word() for _ in range(rng.randint(0, 3)))
    given = [("", ""), ("a", ""), ("a", "a"), ("martha", "marhta"), ("ab", "ac"), ("kumar ramesh", "ramesh kumar"), ("lakshmi devi", "saraswati devi"), ("ramesh patil", "ramesh qqqq"), ("a", "b"), (None, None), (None, "a"), ("tab\tname", "name tab")]
    pairs = given + [(name(), name()) for _ in range(2000)] + [(n, n) for n in (name() for _ in range(20))]
    bags = [names.letter_bag(F.col(c)) for c in "ab"]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.jaro_winkler(F.col("a"), F.col("b")).alias("j"), names.name_score(F.col("a"), F.col("b")).alias("s"), names.name_score_bound(text("a"), text("b"), *bags).alias("most"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    found = df.collect()
    for r in found:
        a, b = r["a"] or "", r["b"] or ""
        assert (r["j"], r["s"]) == (plain_jaro_winkler(a, b), plain_name_score(a, b)), (a, b)
        assert r["most"] >= r["s"] or "\t" in a
    got = {(r["a"], r["b"]): r["s"] for r in found}
    assert got["kumar ramesh", "ramesh kumar"] == 1.0 and got["ramesh patil", "ramesh qqqq"] < 0.65
    assert round(got["lakshmi devi", "saraswati devi"], 4) == 0.8226  # the better of the plain (0.7044) and the sorted comparison


def test_scores(spark):
    row = spark.range(1).select(
        scores.half_up(F.lit(1.005), 2), scores.age_score(F.lit(30), F.lit(35)), scores.age_score(F.lit(30), F.lit(None)), scores.gender_score(F.lit("m"), F.lit(" M ")), scores.gender_score(F.lit("unknown"), F.lit("M")),
        scores.location_score(F.lit("a"), F.lit("b"), F.lit("d"), F.lit("d"), F.lit(1.0)), scores.location_score(F.lit(None), F.lit("b"), F.lit(None), F.lit("d"), F.lit(4.0)), scores.gate(F.lit(0.78)), scores.gate(F.lit(float("nan"))),
        scores.risk_score(F.lit(1), F.lit(1), F.lit(False)), scores.risk_score(F.lit(4), F.lit(9), F.lit(True)), scores.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    ).first()
    assert list(row)[:11] == [1.0, 0.7, 0.5, 1.0, 0.5, 0.6, 0.8, "CONFIRMED", "DISCARD", 3.5, 10.0]
    assert abs(row[11] - 111.1949) < 1e-3
