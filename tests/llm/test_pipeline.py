import pytest

pytest.importorskip("casegraph.llm")
import corpus_pipeline  # noqa: E402
from casegraph.llm import mixing, registry  # noqa: E402


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= docs.count()
        if name in ("line_dedup", "source_mixing"):
            assert n == docs.count()
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in all columns, empty texts, ties, repeated rows and columns with clashing names go through the whole chain."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, key string, ck string, position long"
    clean = [(i, f"this is a sentence of its own number {i} and it goes on with {i * i} more words", "en", "abc"[i % 3], 1, "r", "n", "k", "c", 7) for i in range(40)]
    odd = [(100, None, None, None, None, None, None, None, None, None), (101, "", "en", "a", 0, None, None, None, None, None), (None, "no id at all", "en", None, 3, "r", None, "k", None, 1), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(clean + odd + clean[:5] + [clean[7]] * 4, schema)
    spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = {r[1] for r in clean}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, str(tmp_path))
        assert docs.columns == schema.replace(" string", "").replace(" long", "").split(", "), name
        got = [r["text"] for r in docs.collect()]
        assert texts <= set(got), name
        assert len(got) == before or name == "ngram_jaccard_join"
    assert len(got) == len(clean) + 2  # one of each clean text, one of all without a word, the one without an id
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_packing_follows_the_mixture_over_files_of_unequal_size(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab " * (1500 + i), "abc"[min(2, i % 5)]) for i in range(300)], "doc_id long, text string, source string")
    options = {"block_rows": 64, "period": 1024, "temper": 0.5}
    rows = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    for a, z in ((0, 20), (20, 80), (80, 300)):
        spark.createDataFrame(rows[a:z], docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    place = {r["doc_id"]: r["position"] for r in mixing.mix(docs, **options).collect()}
    assert [place[r["doc_id"]] for r in rows] == list(range(300))
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), "").where("start = 0 and sequence_id >= 0").orderBy("sequence_id", "offset").collect()
    got = [place[r["doc_id"]] for r in pieces]
    assert got == sorted(got) and len(got) == 300


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))


def test_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        cursor = con.execute(sql)
        cols = [c[0] for c in cursor.description]
        got = sorted(tuple(r[c] for c in cols) for r in registry.queries()[name](spark, sf).collect())
        assert got == sorted(cursor.fetchall())
