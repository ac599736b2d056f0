"""Substring search by trigrams, tolerant decoding, texts of cases."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casegraph.operators import dashboard, documents, graph, retrieval
from casegraph.operators.substring import BLOCK, Substrings, scan
from casegraph.sources import decode


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


# ---- substrings


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(1, 6)))
    data = [(i, " ".join(word() for _ in range(draw.randint(0, 12))).title(), "x") for i in range(300)]
    data += [(300, None, "x"), (None, "Needle here", None), (301, "", "x"), (302, "lo" * 3 * BLOCK + "NEEDLE" + "lo" * BLOCK, "x"), (303, "n" * (BLOCK - 3) + "needle", "x"), (304, "a😀b ಕನ್ನಡ", "x"), (304, "a😀b ಕನ್ನಡ", "x")]
    return spark.createDataFrame(data, "id long, text string, found string").drop("found").repartition(12)


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return Substrings.build(texts, F.col("text"), str(tmp_path_factory.mktemp("index") / "i"), folders=8)


@pytest.mark.parametrize("words", [["needle"], ["abc", "EDC"], ["a b"], ["😀b"], ["ನ್ನಡ"], ["zzz"], ["zzz", "cab"], ["lolo"], ["needle", "needle", "NEEDLE"], []])
def test_a_search_finds_what_a_scan_finds(texts, index, words):
    want = rows(scan(texts, F.col("text"), words), "id", "found")
    assert rows(index.search(words, scan_from=100), "id", "found") == want == rows(index.search(words, scan_from=0), "id", "found")
    if words and words != ["zzz"]:
        assert want


@pytest.mark.parametrize("words", [["ab"], [""], ["a", "needle"]])
def test_words_without_a_trigram_scan(texts, index, words):
    assert rows(index.search(words), "id", "found") == rows(scan(texts, F.col("text"), words), "id", "found")


def test_only_folders_with_candidates_are_read(spark, texts, index, tmp_path):
    found = index.candidates(index._rarest(["needle here"], 4))
    held = {r["folder"] for r in found.collect()}
    assert len(held) == 1 and found.count() == 1
    broken = 0
    own = Substrings.build(texts, F.col("text"), str(tmp_path / "i"), folders=8)
    held = {r["folder"] for r in own.candidates(own._rarest(["needle here"], 4)).collect()}
    for f in Path(own.path, "texts").glob("folder=*/*.parquet"):
        if int(f.parent.name.removeprefix("folder=")) not in held:  # the footer stays, so that the schema and the number of rows can be read
            data = f.read_bytes()
            foot = 8 + int.from_bytes(data[-8:-4], "little")
            f.write_bytes(b"\0" * (len(data) - foot) + data[-foot:])
            Path(f.parent, f".{f.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken and rows(own.search(["needle here"], scan_from=100), "id") == [(None,)]
    with pytest.raises(Exception):  # noqa: B017
        own.search(["ab"]).collect()  # a scan does read them


def test_empty_table_and_clashing_columns(spark, tmp_path):
    none = Substrings.build(spark.createDataFrame([], "text string, number long"), F.col("text"), str(tmp_path / "e"))
    assert none.search(["abc"]).count() == 0 and none.search(["a"]).count() == 0
    odd = spark.createDataFrame([("abcd", 7, "f", "w", "g")], "text string, number long, folder string, words string, gram string")
    got = Substrings.build(odd, F.col("text"), str(tmp_path / "o")).search(["bcd"], scan_from=100)
    assert got.columns == [*odd.columns, "found"] and rows(got) == [("abcd", 7, "f", "w", "g", ["bcd"])]


def test_searches_of_the_engine_go_through_the_index(spark, tmp_path):
    cases = spark.sql("SELECT id AS case_id, IF(id % 3 = 0, 'Stolen Vehicle near the lake', 'quiet') AS facts, timestamp'2024-01-01' + make_dt_interval(cast(id as int)) AS incident FROM range(40)")
    hits = Substrings.build(cases, F.col("facts"), str(tmp_path / "c")).search(["vehicle", "lake"], scan_from=100).drop("found")
    assert rows(retrieval.excerpts(hits, ["vehicle", "lake"])) == rows(retrieval.excerpts(cases, ["vehicle", "lake"])) != []
    persons = spark.createDataFrame([("PM_1", "asha rao", ["Asha Rao", "A. Rao"]), ("PM_2", "ravi", None)], "person_id string, name_normalised string, name_variants array<string>")
    every = F.concat_ws("\0", "person_id", "name_normalised", "name_variants")
    found = Substrings.build(persons, every, str(tmp_path / "p"))
    for text in ("a. rao", "pm_", "RAVI"):
        assert rows(graph.named(found.search([text]).drop("found"), text), "person_id") == rows(graph.named(persons, text), "person_id") != []
    names = spark.createDataFrame([(1, "Ring A"), (2, "RING a"), (3, "other")], "ord int, name string")
    assert rows(dashboard.distinct_names(Substrings.build(names, F.col("name"), str(tmp_path / "n")).search(["ring"]), "ring")) == [("Ring A",)]


# ---- decoding

FIELDS = [
    ('[{"k":1},{"k":2}]', (2, 2, 0, 0, 0), [1, 2]), ('"[{\\"k\\":3}]"', (1, 1, 0, 0, 0), [3]), ('["{\\"k\\":4}", "no", 7, null, "[1]", [1]]', (6, 0, 3, 1, 5), [4]), ('{"k":5}', (0, 0, 0, 0, 0), []), ('[{"k":1}', (0, 0, 0, 0, 0), []),
    (None, (0, 0, 0, 0, 0), []), ("", (0, 0, 0, 0, 0), []), ('[{"k":1}] x', (0, 0, 0, 0, 0), []), ('[{"k":1}], x]', (0, 0, 0, 0, 0), []), ('[{"k":1}]}', (0, 0, 0, 0, 0), []), ("[] []", (0, 0, 0, 0, 0), []), ("[]", (0, 0, 0, 0, 0), []),
    ('[{"k":"z"},{"j":2}]', (2, 2, 0, 0, 0), [None, None]), ('["{\\"k\\":1} {"]', (1, 0, 1, 0, 1), []), ('["\\"{}\\""]', (1, 0, 1, 0, 1), []), ('7', (0, 0, 0, 0, 0), []), ('"no"', (0, 0, 0, 0, 0), []), ("null", (0, 0, 0, 0, 0), []),
]


def test_each_shape_is_decoded_and_counted(spark):
    df = spark.createDataFrame([(i, f, "own") for i, (f, _, _) in enumerate(FIELDS)], "i int, f string, _seen string")
    out = decode.decoded(df.withColumnRenamed("_seen", "seen"), "f", "k long")
    for r in out.collect():
        assert tuple(r["shapes"]) == FIELDS[r["i"]][1], FIELDS[r["i"]]
        assert [x["k"] for x in r["records"]] == FIELDS[r["i"]][2], FIELDS[r["i"]]
    total = decode.diagnostics(out).first()
    assert tuple(total) == tuple(sum(s[k] for _, s, _ in FIELDS) for k in range(5))
    assert decode.decoded(df.drop("_seen"), "f").select(F.col("records").cast("array<string>")).first()[0] == ['{"k":1}', '{"k":2}']
    assert tuple(decode.diagnostics(out.where("false")).first()) == (0, 0, 0, 0, 0)


# ---- texts of cases


def test_a_case_has_its_sections_in_order(spark):
    heads = spark.createDataFrame([(1, "Case: 1"), (2, "Case: 2"), (None, "none")], "case_id long, line string")
    people = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "a", 2), (1, None, 1), (9, "stray", 1), (None, "x", 1)], "case_id long, name string, n int")
    got = documents.case_documents(heads, [documents.facts(people, "case_id", 2, documents.line("  ACCUSED: ", F.col("name")), F.col("n"))], {1: "SECTIONS:", 2: "PERSONS:"})
    assert rows(got) == [(1, "Case: 1\n\nPERSONS:\n  ACCUSED: N/A\n  ACCUSED: a\n  ACCUSED: a\n  ACCUSED: b"), (2, "Case: 2")]


def test_facts_of_all_tables_meet_in_one_exchange(spark, sf):
    from casegraph.plans import catalogue

    plan = catalogue.case_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    cut = plan.index("Union")
    assert plan[:cut].count("Exchange") == 1, plan


def test_batches_are_numbered_over_all_cases(spark):
    docs = spark.range(0, 450).select((F.col("id") * 3).alias("case_id"), F.concat(F.lit("t"), F.col("id")).alias("text")).repartition(7)
    got = dict(rows(documents.batches(docs)))
    assert sorted(got) == [1, 2, 3]
    assert got[2].startswith("=== CASES ===\n=== BATCH 2 (Cases 201-400) ===\n\n=== CASE 201 ===\nt200\n===\n\n=== CASE 202 ===\nt201") and "(Cases 401-450)" in got[3]


def test_lookup_lines_leave_out_what_is_missing(spark):
    t = spark.createDataFrame([(1, "x", None), (2, "", "z")], "id int, `a.b` string, c string")
    assert rows(documents.lookup_lines(t)) == [("  id: 1, a.b: x",), ("  id: 2, c: z",)]
