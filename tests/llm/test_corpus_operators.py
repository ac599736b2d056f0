"""The corpus operators on small tables with awkward rows, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("casegraph.llm")
from casegraph.llm import chosen_path, fingerprint, grams, language, lattice_lm, line_dedup, media, mixing, packing, quality, sharding  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, key string"


def make(seed=0, n=60):
    """Documents with nulls in every column, empty and very long texts, repeated rows, one id with two texts, clashing names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = [(i, "\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "de"]), rng.choice("abc"), 5, "r", "n", "k") for i in range(n)]
    common = "  Shared LINE of many \t"
    out = [(i, f"{common.strip() if i % 2 else common}\n{t}", *rest) if i % 3 == 0 else (i, t, *rest) for i, t, *rest in out]
    base = line(40)
    near = [base, base + " tail", "head " + base, base.upper(), base.replace(" ", "  ")]
    out += [(100 + i, t, "en", "a", 1, None, None, None) for i, t in enumerate(near)]
    odd = [(200, None), (201, ""), (202, " \n\t\n"), (203, "123 !!"), (204, "one\n"), (205, "\n\n\n"), (206, "日本語 テキスト\nß É"), (207, "x" * 50_000 + " " + line(20_000)), (None, "no id here at all"), (None, None)]
    out += [(i, t, None, None, None, None, None, None) for i, t in odd]
    out += [out[0], out[0], (3, "another text of the same id", "en", "b", 2, "r", "n", "k"), out[61]]
    return out


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(t):
    return t or ""


def order(x):
    return sorted(x, key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ------------------------------------------------------------------ 1


def test_media_round_trip(docs, none, rows):
    got = media.media_columns(docs).collect()
    want = []
    for i, t, *_ in rows:
        b = text(t).encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        want.append((i, len(b), len(p), sha(p), zlib.crc32(p[-16:]), len(p) // 192))
    assert order((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["height"]) for r in got) == order(want)
    values = defaultdict(set)
    for r in got:
        values[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in values.values())
    assert media.media_columns(none).count() == 0


def test_media_tar_and_png(docs):
    import tarfile

    manifest = media.store(docs).collect()
    for shard in {r["shard"] for r in manifest}:
        with tarfile.open("/" + shard.removeprefix("file:").lstrip("/")) as tar:
            members = {m.offset_data: m for m in tar.getmembers()}
            mine = [r for r in manifest if r["shard"] == shard]
            assert len(members) == len({r["digest"] for r in mine})
            for r in mine:
                m = members[r["offset"]]
                assert (m.name, m.size) == (f"{r['digest']}.png", r["length"])
                assert sha(media.decode_png(tar.extractfile(m).read())) == r["digest"]
    broken = bytearray(media.encode_png(b" " * 192))
    broken[20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


# ------------------------------------------------------------------ 2


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, least, keep_first=False):
    where = defaultdict(set)
    for i, t in {(i, text(t)) for i, t, *_ in rows}:
        for x in t.split("\n"):
            if line_key(x):
                where[line_key(x)].add((i, t))
    common = {k for k, v in where.items() if len(v) >= least}
    return common


@pytest.mark.parametrize("least", [1, 2, 10])
def test_line_dedup(docs, rows, least):
    common = brute_lines(rows, least)
    want = []
    for i, t, *_ in rows:
        parts = text(t).split("\n")
        kept = [x for x in parts if line_key(x) not in common]
        want.append((i, len(parts), len(parts) - len(kept), sha("\n".join(kept).encode())))
    assert order(tuple(r) for r in line_dedup.line_dedup(docs, min_docs=least).collect()) == order(want)


def test_line_dedup_keeps_first_occurrences(spark, docs, rows, none):
    got = line_dedup.drop_lines(docs, min_docs=10)
    assert got.schema == docs.schema or got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows) and line_dedup.drop_lines(none).count() == 0 and line_dedup.line_dedup(none).count() == 0
    lines = Counter(line_key(x) for r in {(r["doc_id"], text(r["text"])) for r in out} for x in r[1].split("\n"))
    assert all(lines[k] == 1 for k in brute_lines(rows, 10))
    assert all(r["n_chars"] is None or r["text"] is None or r["n_chars"] == len(r["text"]) for r in out)


def test_line_runs_over_partition_borders(spark):
    """One line in all documents, over more partitions than it has neighbours."""
    many = spark.createDataFrame([(i, "hot\nhot\nown %d" % i if i % 2 else "cold %d\nhot" % i) for i in range(300)], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = line_dedup.line_dedup(many, min_docs=10).collect()
        first = line_dedup.drop_lines(many, min_docs=10).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(r["n_dropped"] == (2 if r["doc_id"] % 2 else 1) for r in got)
    assert [r["doc_id"] for r in first if "hot" in r["text"].split("\n")] == [0]
    assert line_dedup.line_dedup(many, min_docs=301).where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("held", [0, 5, 1 << 20])
def test_many_equal_lines_of_few_documents(spark, monkeypatch, held):
    """A task holds a bounded number of undecided rows; what it writes undecided gets the same outcome."""
    monkeypatch.setattr(line_dedup, "MOST_HELD", held)
    runs = {"x": (4, 60), "y": (3, 50), "z": (9, 1), "w": (2, 70)}  # of each line: in how many documents, how often in each
    texts = {i: "\n".join(line for line, (docs, times) in runs.items() if i < docs for _ in range(times)) for i in range(9)}
    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    for least in (3, 4, 5):
        gone = {line for line, (docs, _) in runs.items() if docs >= least}
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(d, min_docs=least).collect()}
        assert got == {i: sum(line in gone for line in t.split("\n")) for i, t in texts.items()}
        kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(d, min_docs=least).collect()}
        seen: set[str] = set()
        for i, t in texts.items():
            want = []
            for line in t.split("\n"):
                if line not in gone or line not in seen:
                    want.append(line)
                seen.add(line)
            assert kept[i] == "\n".join(want)


# ------------------------------------------------------------------ 3 and 4


def test_grams_of_long_texts(monkeypatch):
    monkeypatch.setattr(grams, "STRETCH", 64)
    rng, table = random.Random(1), np.random.default_rng(0).normal(size=(256, 3))
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 300, 64, 128, 129, 1, 7, 131, 0)]
    for t, got in zip(texts, grams.mean_weights(texts, table, (1, 2, 4), 8), strict=True):
        d = np.frombuffer(t, dtype=np.uint8)
        h = np.concatenate([grams.buckets(d, n, 8) for n in (1, 2, 4)]) if t else []
        assert np.allclose(got, table[h].mean(axis=0) if len(h) else 0)


def test_language(spark, docs, none, rows):
    rng = random.Random(2)
    words = {"en": "the of and tion ing that with".split(), "fr": "le eau oux tre é è une".split()}
    data = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 30))), x) for i, x in enumerate(["en", "fr"] * 150)]
    got = language.held_out_predictions(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    truth = {i: x for i, _, x in data}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = language.held_out_predictions(docs).collect()
    assert len(odd) == len(rows)
    for r in odd:
        if r["doc_id"] in (200, 201, 202, 203, 205):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    assert language.held_out_predictions(none).count() == 0
    unlabelled = language.held_out_predictions(docs.withColumn("lang", docs["lang"].substr(9, 0)).where("lang is null"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_quality(spark, docs, none, rows):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrnm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 200)))
    junk = lambda: "!! ".join(w.upper() for w in prose().split())
    data = [(i, junk() if i % 5 == 0 else prose(), "en", f"s{i % 3}", 1) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0, "x") for i in range(200)], "doc_id long, quality int, toxic int, text string")
    got = quality.classify(d, labels).collect()
    assert sum(r["keep"] == (r["doc_id"] % 5 != 0) for r in got) / len(got) > 0.98 and len(got) == 400
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and not [r for r in kept.collect() if r["doc_id"] % 5 == 0][8:]
    assert quality.classify(docs, labels.where("false")).where("keep").count() == len(rows)
    for q in (0, 1):  # labels of one class are no model: all stay
        one = labels.selectExpr("doc_id", f"{q} as quality")
        assert quality.keep_good(d, one).count() == 400 and {r["quality_prob"] for r in quality.classify(d, one).where("keep").collect()} == {float(q)}
    assert quality.keep_good(d, labels.where("doc_id > 1000000").union(labels.selectExpr("doc_id + 1000000", "quality", "toxic", "text"))).count() == 400  # labels of other documents
    first = sorted((r["doc_id"], r["quality_prob"]) for r in got)
    again = quality.classify(d.union(d).repartition(7), labels.repartition(3)).distinct().collect()
    assert [i for i, _ in first] == sorted(r["doc_id"] for r in again)  # repeated rows get equal scores
    assert sum(r["keep"] == (r["doc_id"] % 5 != 0) for r in again) / len(again) > 0.98
    assert quality.classify(docs, labels).count() == len(rows) and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(none, labels).count() == 0


# ------------------------------------------------------------------ 5


def test_sharding(spark, docs, none, rows):
    got = sharding.by_bytes(docs, 4).collect()
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == order((i, len(text(t).encode()) + 16, zlib.crc32(text(t).encode())) for i, t, *_ in rows)
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.by_bytes(none).count() == 0
    copies = spark.createDataFrame([(i, "same text" * 9 if i % 3 else f"text {i} " * (1 + i % 9)) for i in range(3000)], "doc_id long, text string")
    size = Counter()
    for r in sharding.by_bytes(copies, 8).collect():
        size[r["shard"]] += r["size"]
    assert max(size.values()) / (sum(size.values()) / 8) < 1.02 and len(size) == 8


def test_placement_by_dot_products():
    """The largest item first, each where the dot product of residual capacity and item is highest, one by one."""
    rng = np.random.default_rng(1)
    v = rng.integers(1, 1000, (60, 3)).astype(float)
    share = [[float(x) / float(t) for x, t in zip(r, v.sum(axis=0), strict=True)] for r in v]
    left, want = [[1 / 7] * 3 for _ in range(7)], {}
    for i in sorted(range(60), key=lambda i: (-max(share[i]), i)):
        k = max(range(7), key=lambda s: (sum(a * b for a, b in zip(left[s], share[i], strict=True)), -s))
        want[i], left[k] = k, [a - b for a, b in zip(left[k], share[i], strict=True)]
    assert sharding.pack(v, 7).tolist() == [want[i] for i in range(60)]


def test_items_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    d = spark.createDataFrame([(i % 400, "same" if i % 2 else f"t {i}") for i in range(500)], "doc_id long, text string")
    slots = defaultdict(list)
    for r in sharding.by_bytes(d, 4).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 500


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups of 2 to 40 copies, each beyond a cell's share and below a shard's, and one group larger than a shard."""
    data = [f"group {g} " * (1 + g % 5) for g in range(40) for _ in range(2 + g)] + [f"single {i} " * (1 + i % 7) for i in range(600)] + ["too large for one " * 4] * 500
    d = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    where, size, rows = defaultdict(set), Counter(), Counter()
    for r in sharding.by_bytes(d, 8).collect():
        where[data[r["doc_id"]]].add(r["shard"])
        size[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("too large"))
    assert len(where["too large for one " * 4]) > 1
    assert max(size.values()) / (sum(size.values()) / 8) < 1.03 and sum(rows.values()) == len(data)


# ------------------------------------------------------------------ 6


def brute_links(rows, threshold=0.8):
    def shingles(t):
        w = text(t).lower().split()
        return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t, *_ in rows]
    same = lambda a, b: a == b or (bool(a | b) and len(a & b) >= threshold * len(a | b))
    links = [{j for j, b in enumerate(sets) if j != i and same(a, b)} for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
    least = defaultdict(list)
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g].append(rows[i][0])
    return [(rows[i][0], min(least[g], default=None), len(links[i])) for i, g in enumerate(group)]


def test_join(docs, none, rows):
    assert order(tuple(r) for r in chosen_path.near_duplicates(docs).collect()) == order(brute_links(rows))
    assert chosen_path.near_duplicates(none).count() == 0


@pytest.mark.parametrize("small", [8, 1024])
def test_join_of_a_large_group(spark, small):
    """A group of near copies larger than a bucket and a cell: split, cut in cells, and still whole."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    data = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = chosen_path.near_duplicates(d, small=small, cell=16).collect()
    assert order(tuple(r) for r in got) == order(brute_links(data))


def test_one_of_each(docs, rows):
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], text(r["text"])) for r in kept.collect()]
    assert 100 in dict(got) and not {101, 102, 103, 104} & set(dict(got)) and [i for i, _ in got].count(0) == 1
    # one row of each group, whatever its ids: the least id (null first), then the least hash of the text
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := text(t).lower().split()) else frozenset() for _, t, *_ in rows]
    same = lambda a, b: a == b or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j, b in enumerate(sets) if same(a, b)) for a in sets]
    members = defaultdict(list)
    for (i, t, *_), g in zip(rows, group, strict=True):
        members[g].append((i, text(t)))
    assert len(got) == len(members) and order(got) == order(x for g in members.values() for x in set(g) if x in got)
    for g in members.values():
        mine = [x for x in got if x in g]
        assert len(mine) == 1 and mine[0][0] == (None if any(i is None for i, _ in g) else min(i for i, _ in g))


def test_runs_reach_recall():
    assert chosen_path.survival(0.8, 1.5, 1) == pytest.approx(1 - math.exp(-1.2))
    n = chosen_path.runs_for(0.999, 0.8, 1.5)
    assert (1 - chosen_path.survival(0.8, 1.5, 2)) ** n <= 0.001


@pytest.mark.parametrize("seed", [0, 1])
def test_large_buckets_lose_no_pair(spark, seed):
    """A passage in all texts puts them in buckets that are pooled; pairs near the threshold among them are all found."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    data = []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(20)]
        data += [own[: 20 - rng.randint(0, 4)] + [f"t{g}"] * rng.randint(0, 2) + passage for _ in range(rng.randint(1, 3))]
    rows = list(enumerate(map(" ".join, data)))
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=6, cell=16)
    assert order(tuple(r) for r in got.collect()) == order(brute_links(rows))


def test_hot_null_ids(spark):
    """Rows without an id that hold different texts don't meet each other."""
    rows = [(None, f"text number {i} with some words of its own {i}") for i in range(300)] + [(None, "the same"), (5, "the same"), (None, "The  same")]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(tuple(r) for r in got) == order(brute_links(rows))


# ------------------------------------------------------------------ 7


def test_lattice_sums_all_segmentations():
    p = lattice_lm.first_pieces(lattice_lm.default_vocabulary())

    def brute(s):
        total = 0.0
        for m in range(1 << (len(s) - 1)):
            cut = [0, *(i + 1 for i in range(len(s) - 1) if m >> i & 1), len(s)]
            lps = []
            for a, b in zip(cut, cut[1:], strict=False):
                w = s[a:b]
                lps.append(p.log_p[w] if w in p.log_p else sum(p.log_p[x] for x in lattice_lm.byte_pieces(w)) if len(w) == 1 else -math.inf)
            total += math.exp(sum(lps))
        return math.log(total)

    words = ["the", "thntion", "éreau", "a", "", "x" * 9, "日本𓀀", "$$$a", "q" * 60]
    for w in words[:-1]:
        assert p.one(w) == pytest.approx(brute(lattice_lm.START + w))
    assert np.allclose(p.many(words), [p.one(w) for w in words])
    n, one, many = np.arange(1.0, 10.0), np.zeros(len(p.log_p) + 1), np.zeros(len(p.log_p) + 1)
    p.many(words, n, many)
    for w, k in zip(words, n, strict=True):
        p.one(w, k, one)
    assert np.allclose(one, many)


def test_long_words_hold_no_edges():
    """The memory of a word of 90 000 letters: two floats a letter, not its edges."""
    import tracemalloc

    p = lattice_lm.first_pieces(lattice_lm.default_vocabulary())
    word = "thequickx" * 10_000
    tracemalloc.start()
    into = np.zeros(len(p.log_p) + 1)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    [lp] = p.many([word], np.ones(1), into)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert lp == pytest.approx(p.one(word)) and peak < 16 * len(word) + (1 << 19)
    sizes = np.array([1 if x.startswith("<0x") else len(x) for x in p.log_p])
    # the pieces of each segmentation spell the word; large logs are rounded at each letter
    assert (into[:-1] * sizes).sum() == pytest.approx(len(word) + 1, rel=1e-4)


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_language_model(docs, none, rows, hot):
    got = lattice_lm.lm_scores(docs, rounds=1, hot_words=hot).collect()
    tok = [lattice_lm.tokens(text(t).encode()) + [b"\0end"] for _, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter(w for ws, h in zip(tok, held, strict=True) if not h for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = [(i, h, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6)) for (i, *_), ws, h in zip(rows, tok, held, strict=True)]
    assert order((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == order(want)
    assert all(r["score"] < 0 for r in got) and lattice_lm.lm_scores(none).count() == 0


def test_score_is_the_sum_over_words(docs, rows):
    """Without refitting, a text's score is the sum of its words' marginals under the vocabulary's own scores, and its end."""
    p = lattice_lm.first_pieces(lattice_lm.default_vocabulary())
    for hot in (0, 10**6):
        got = order((r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in lattice_lm.lm_scores(docs, rounds=0, hot_words=hot).collect())
        words = [[w.decode() for w in lattice_lm.tokens(text(t).encode())] for _, t, *_ in rows]
        price = {w: p.one(w) for ws in words for w in ws}
        assert got == order((i, len(ws) + 1, round((sum(price[w] for w in ws) + p.log_p[lattice_lm.END]) / math.log(10), 5)) for (i, *_), ws in zip(rows, words, strict=True))


# ------------------------------------------------------------------ 8


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*rows, (300, "a <|endoftext|> b<|endoftext|>", *rows[0][2:])]
    docs = docs.union(docs.sparkSession.createDataFrame(rows[-1:], SCHEMA))
    ids = Counter()
    for i, t, *_ in rows:
        x = np.array([*tok.encode(text(t), add_special_tokens=False).ids, 0], dtype="<u4")
        ids[i, x.tobytes()] += 1
    got = packing.pack(docs, open_windows=4).collect()
    assert sum(r["length"] for r in got) == sum(len(b) // 4 * n for (_, b), n in ids.items())
    texts = defaultdict(list)
    for i, b in ids:
        texts[i].append(b)
    for r in got:
        assert any(len(b) // 4 == r["doc_tokens"] and zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for b in texts[r["doc_id"]])
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    used = sum(r["length"] for r in got)
    assert len(by) <= used / 1024 * 1.02 + 1 and packing.pack(none).count() == 0


@pytest.mark.parametrize("t", ["", "a", " a", "a ", "a\n", "\n", "a  b", "a\tb", "don't we're\nI'll 's 's", "x y", "a 's\n's b", "<|endoftext|> x", "a <|endoftext|>  b <|endoftext|><|endoftext|>", "日本 ß\n\nq"])
def test_ids_equal_the_tokenisers(t):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.Ids(packing.default_vocabulary(), packing.default_tokenizer())(t) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_a_long_document_is_cut_in_one_pass():
    p = packing.Packer(4, 2, 0, 0, False)
    ids = np.arange(4_000_003, dtype="<u4").tobytes()
    p.add(1, 0, ids, 4_000_003)
    assert len(p.rows) == 1_000_000 and [w.free for w in p.open] == [1]
    assert p.rows[777_777][:4] == (1, 4 * 777_777, 4, zlib.crc32(ids[16 * 777_777 : 16 * 777_778]))
    assert p.open[0].pieces == [(1, 4_000_000, ids[16_000_000:], 4_000_003)]


def test_best_fit_and_the_fullest_goes():
    """Against a plain restatement of the rule: best fit, else the fullest window is completed by a cut and goes."""
    rng = random.Random(4)
    docs = [rng.randint(1, 40) for _ in range(200)]
    packer, open_, want = packing.Packer(16, 3, 2, 0, False), [], []
    for i, n in enumerate(docs):
        packer.add(i, 0, bytes(4 * n), n)
        start = 0
        while n - start >= 16:
            want.append([(i, start, 16)])
            start += 16
        if n == start:
            continue
        fits = [w for w in open_ if sum(x[2] for x in w) + n - start <= 16]
        if fits:
            to = max(fits, key=lambda w: sum(x[2] for x in w))
        else:
            if len(open_) == 3:
                full = max(open_, key=lambda w: sum(x[2] for x in w))
                room = 16 - sum(x[2] for x in full)
                if room > 2:
                    full.append((i, start, room))
                    start += room
                want.append(full)
                open_.remove(full)
            to = []
            open_.append(to)
        to.append((i, start, n - start))
        if sum(x[2] for x in to) == 16:
            want.append(to)
            open_.remove(to)
    got = defaultdict(list)
    for doc_id, start, n, _, _, seq, *_ in packer.rows:
        got[seq].append((doc_id, start, n))
    assert [got[k] for k in sorted(got)] == want and [w.pieces[0][0] for w in packer.open] == [w[0][0] for w in open_]


# ------------------------------------------------------------------ 9


def test_fingerprints(spark, docs, none, rows):
    got = fingerprint.edit_likeness(docs).collect()
    plain = order({(i, text(t)) for i, t, *_ in rows if i is not None})
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    sizes = {(i, len(t)) for i, t in plain}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            assert (r["doc_id"], r["n_chars"]) in sizes
            by_text[r["doc_id"], r["n_chars"]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    one = [(i, t) for i, t in sorted((i, text(t)) for i, t, *_ in rows if i is not None) if i < 60 and i not in (0, 3)]
    unique = spark.createDataFrame([*one, (9, one[7][1])][:-1], "doc_id long, text string")
    want = {i: sha((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()) for (i, a), (_, b) in zip(one, one[1:] + one[:1], strict=True)}
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edit_likeness(unique).collect()} == want
    assert fingerprint.edit_likeness(none).count() == 0


def test_cells_join_up(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELL_ROWS", 4)
    data = [(i * 7 % 101 - 50, f"text {i} " * (i % 5)) for i in range(101)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edit_likeness(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    s = sorted(data)
    assert got == {i: sha((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()) for (i, a), (_, b) in zip(s, s[1:] + s[:1], strict=True)}


def test_borders_and_outliers(spark, monkeypatch):
    """Cells follow where the ids lie; a search over several levels counts as a sorted list does."""
    import bisect

    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "FAN", 3)
    rng = random.Random(6)
    for n in (0, 1, 3, 4, 9, 10, 27, 30, 80):
        borders = sorted(rng.sample(range(-100, 100), n))
        ids = [-101, *borders, 0, 5, 101, None]
        got = spark.createDataFrame([(i,) for i in ids], "i long").select(fingerprint.borders_below(F.col("i"), borders)).collect()
        assert [r[0] for r in got] == [None if i is None else bisect.bisect_right(borders, i) for i in ids]
    monkeypatch.setattr(fingerprint, "CELL_ROWS", 10)
    d = spark.createDataFrame([(i, f"t{i}", i) for i in range(1000)] + [(1 << 62, "far", 0), (-(1 << 62), "low", 0)], "doc_id long, text string, thash long")
    sizes = [r["count"] for r in fingerprint.in_cells(d)[0].where("guest = 0").groupBy("cell").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 120 and sum(sizes) == 1002


def test_fingerprints_are_homomorphic(spark):
    a, b = "one two\nthree. four five", "six\nseven! eight"
    d = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}"), (4, "three\nseven\nsix. four five. one two\neight"), (5, "")], "doc_id long, text string")
    fp = {r["doc_id"]: r["lanes"] for r in fingerprint.fingerprints(d).collect()}
    assert fp[3] == fp[4] and fp[1] != fp[2] and set(fp[5]) == {0}
    pair = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a array<long>, b array<long>, c array<long>")
    from pyspark.sql import functions as F

    r = pair.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("c"), F.col("b"), remove=True).alias("left")).first()
    assert r["sum"] == fp[3] and r["left"] == fp[1]


# ------------------------------------------------------------------ 10


def simulate(quota):
    """Earliest deadline first over one period, slot by slot."""
    period, done, out = sum(quota), [0] * len(quota), []
    for t in range(period):
        ready = [(-(-(done[i] + 1) * period // q), i) for i, q in enumerate(quota) if done[i] < q and done[i] * period // q <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def test_earliest_deadline_first(spark):
    from pyspark.sql import functions as F

    for quota in ([1], [3, 2, 1], [5, 1, 1, 1], [7, 7, 2], [40, 23, 1]):
        q = spark.range(1).select(F.array(*(F.lit(x).cast("long") for x in quota)).alias("q"), F.lit(sum(quota)).cast("long").alias("period"))
        assert q.select(mixing.earliest_deadline_first(F.col("q"), F.col("period"))).first()[0] == simulate(quota)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, None: 0.5}])
def test_mixing(docs, none, rows, weights):
    got = mixing.mix(docs, weights, block_rows=2, period=16).collect()
    assert order((r["doc_id"], r["source"]) for r in got) == order((i, s) for i, _, _, s, *_ in rows)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    slots = defaultdict(set)
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        slots[r["slot"]].add((r["source"], r["block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    assert mixing.mix(none).count() == 0
    ordered = mixing.in_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0})


def test_whole_schedule_against_a_simulation(spark):
    """Several phases, slot by slot: of the released blocks the one with the earliest deadline, by exact weights."""
    from fractions import Fraction

    n, block = {"a": 37, "b": 90, "c": 11, "d": 52}, 4
    weights = {"a": 3.0, "b": 1.0, "c": 0.5, "d": 2.0}
    d = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, source string")
    got = {(r["source"], r["block"]): r["slot"] for r in mixing.mix(d, weights, block_rows=block, period=8).collect()}
    left, want, slot = {s: -(-k // block) for s, k in n.items()}, {}, 0
    while left:
        total, done, t = sum(Fraction(weights[s]) for s in left), dict.fromkeys(left, 0), 0
        w = {s: Fraction(weights[s]) / total for s in left}
        while all(done[s] < left[s] for s in left):
            ready = [(math.ceil((done[s] + 1) / w[s]), s) for s in sorted(left) if done[s] / w[s] < t + 1]
            s = min(ready)[1]
            want[s, -(-n[s] // block) - left[s] + done[s]] = slot + t
            done[s] += 1
            t += 1
        slot += t
        left = {s: left[s] - done[s] for s in left if left[s] > done[s]}
    assert got == want


def test_longer_stretches_give_the_same_order(spark, monkeypatch):
    """However many blocks there are they keep their size, and the schedule doesn't depend on how it is dealt to tasks."""
    d = spark.createDataFrame([(i, "aabcccc"[i % 7]) for i in range(700)], "doc_id long, source string")
    mixed = lambda period: sorted(tuple(r) for r in mixing.mix(d, {"a": 3.0, "b": 1.0, "c": 2.5}, block_rows=2, period=period).collect())
    want = mixed(1024)
    for most in (1, 3, 1024):
        monkeypatch.setattr(mixing, "MOST_STRETCHES", most)
        assert mixed(7) == want
    assert len({r[3] for r in want if r[1] == "c"}) == 200


def test_hundreds_of_sources(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 300) AS source")
    got = mixing.mix(d, {f"s{i}": 1.0 + i % 7 for i in range(300)}, block_rows=4, period=64).collect()
    assert sorted(r["position"] for r in got) == list(range(3000)) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_two_texts_of_one_id_have_fixed_places(spark):
    d = spark.createDataFrame([(i % 5, f"text {i}", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    first = [r["text"] for r in mixing.in_order(d, block_rows=2).collect()]
    assert first == [r["text"] for r in mixing.in_order(d.orderBy(d["text"].desc()).repartition(5), block_rows=2).collect()] and len(set(first)) == 60


def test_mixing_stays_within_a_block(spark):
    d = spark.createDataFrame([(i, "abc"[min(2, i % 7)]) for i in range(700)], "doc_id long, source string")
    got = sorted(mixing.mix(d, {"a": 1.0, "b": 1.0, "c": 5.0}, block_rows=1, period=14).collect(), key=lambda r: r["slot"])
    seen = Counter()
    for t, r in enumerate(got, 1):
        seen[r["source"]] += 1
        for s, w in (("a", 1 / 7), ("b", 1 / 7), ("c", 5 / 7)):
            assert abs(seen[s] - w * t) < 1


@pytest.mark.parametrize("weights,rows", [({"a": 1.0, "b": 2.0}, {"a": 400, "b": 800}), ({"a": 1.0, "b": 700.0, "c": 2999.0}, {"a": 3, "b": 600, "c": 2400}), ({"a": 5.0} | {f"s{i:02}": 1.0 for i in range(23)}, {"a": 700} | {f"s{i:02}": 140 for i in range(23)})])
def test_mixing_keeps_to_the_weights_over_many_periods(spark, weights, rows):
    """Weights that don't divide the period: within a block until the first source ends."""
    d = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in rows.items() for _ in range(n))], "doc_id long, source string")
    got = sorted(mixing.mix(d, weights, block_rows=1, period=16).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == [r["position"] for r in got] == list(range(len(d.collect())))
    seen, total = Counter(), sum(weights.values())
    for t, r in enumerate(got, 1):
        seen[r["source"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"]
        assert all(abs(seen[s] - w / total * t) < 1 for s, w in weights.items())
        if seen[r["source"]] == rows[r["source"]]:
            break
    assert t > 50 * 16
