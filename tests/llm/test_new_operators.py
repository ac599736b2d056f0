"""Best-two-fit packing, conversation repair and whitening on small tables with awkward rows, against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

pytest.importorskip("casegraph.llm")
from casegraph.llm import conversation, packing, two_fit, whitening  # noqa: E402
from casegraph.sources.shared import shared_dir  # noqa: E402

# ---- best-two-fit packing


def one_at_a_time(lengths, size):
    """Best-two-fit on a list of lengths, a bin after another."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        out, gap = [], size
        while (fits := next((n for n in left if n <= gap), None)) is not None:
            left.remove(fits)
            out.append(fits)
            gap -= fits
        if gap and len(out) > 1:
            low = min(out)
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if low < a + b <= gap + low]
            if pairs:
                total, a = max(pairs)
                out.remove(low)
                left.remove(a)
                left.remove(total - a)
                out += [a, total - a]
                left = sorted([*left, low], reverse=True)
        bins.append(sorted(out))
    return sorted(bins)


def test_plan_is_best_two_fit():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.randint(4, 60)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 8)) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=size + 1) if lengths else np.zeros(size + 1, dtype=np.int64)
        got = sorted(sorted(n for n, k in b.items() for _ in range(k)) for times, b in two_fit.two_fit(counts, size) for _ in range(times))
        assert got == one_at_a_time(lengths, size)


def test_plan_grows_with_lengths_not_with_pieces():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(2048, np.exp(rng.normal(5.5, 1.2, 200_000)).astype(int) + 1), minlength=2049)
    small, large = two_fit.two_fit(counts, 2048), two_fit.two_fit(counts * 1_000_000, 2048)
    assert len(large) < 2 * len(small)
    tokens = int((counts * np.arange(2049)).sum()) * 1_000_000
    assert sum(t for t, _ in large) <= tokens / 2048 * 1.001


def test_cuts():
    assert list(two_fit.cuts(5, 8)) == [(0, 5)] and list(two_fit.cuts(8, 8)) == [(0, 8)]
    assert list(two_fit.cuts(19, 8)) == [(0, 3), (3, 8), (11, 8)] and list(two_fit.cuts(16, 8)) == [(0, 8), (8, 8)]


def test_pieces_are_whole_and_placed(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "be", "gamma", "\n", "delta!"]) for _ in range(rng.randint(0, 90))) for i in range(80)}
    texts |= {100: None, 101: "", 102: " ".join(["word"] * 700), 103: "x" * 4000, 104: texts[3]}
    rows = [(i, t, "a", 1) for i, t in texts.items()] + [(3, texts[3], "a", 1)] * 30 + [(None, None, None, None), (None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, number long").repartition(4)
    got = two_fit.pack(docs, size=64).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    seqs, seen = {}, {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault((r["doc_id"], r["doc_tokens"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(r)
    for places in seqs.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 64
    assert sorted(seqs) == list(range(len(seqs)))
    want = {}
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, (start, n) in enumerate(two_fit.cuts(len(ids), 64)):
            k = (i, len(ids), piece, start, n, zlib.crc32(np.asarray(ids[start : start + n], dtype="<u4").tobytes()))
            want[k] = want.get(k, 0) + 1
    assert {k: len(v) for k, v in seen.items()} == want
    counts = np.bincount([r["length"] for r in got], minlength=65)
    assert len(seqs) == sum(t for t, _ in two_fit.two_fit(counts, 64)) == len(one_at_a_time([r["length"] for r in got], 64))
    assert two_fit.pack(docs.where("false")).count() == 0


@pytest.fixture
def parts_kept(spark):
    """Fifty shuffle partitions that aren't joined up, however small."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield Path(urlparse(shared_dir(spark)).path, "casegraph")
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("a_file", "files"), [(1 << 18, 1), (64, 5)])
def test_counts_take_files_by_their_rows_and_one_job(spark, parts_kept, monkeypatch, a_file, files):
    monkeypatch.setattr(two_fit, "COUNTS_A_FILE", a_file, raising=False)
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(400)], "doc_id long, text string").repartition(4)
    known = set(parts_kept.glob("counts-*"))
    spark.sparkContext.setJobGroup(f"two_fit {files}", "")
    try:
        packed = two_fit.pack(docs, size=64)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"two_fit {files}")) < 20  # not one a partition
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    (made,) = set(parts_kept.glob("counts-*")) - known
    assert len(list(made.glob("*.parquet"))) == files
    rows = sorted(packed.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    ends = {}
    for r in rows:
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and list(ends) == list(range(len(ends)))


# ---- conversation repair

SPACE = " \t\n\x0b\x0c\r"


def cheapest(messages):
    """The least (cost, audit) by trying all edits state by state."""
    none = (10**9, "")

    def inserted(v):
        for _ in range(4):
            for a, b in (("Z", "U"), ("Y", "U"), ("A", "U"), ("U", "A")):
                if a in v:
                    v[b] = min(v.get(b, none), (v[a][0] + 3, v[a][1] + "I"))
        return v

    v = inserted({"Z": (0, "")})
    for initial, must, cut in messages:
        new = {}

        def put(s, cost, audit):
            new[s] = min(new.get(s, none), (cost, audit))  # noqa: B023

        for s, (cost, audit) in v.items():
            put(s, cost + 4, audit + "D")
            if not must:
                after = "A" if s == "U" else "U"
                put(after, cost + 3 + 3 * cut, audit + "R")
                if initial == after.lower():
                    put(after, cost + 3 * cut, audit + "K")
                if s == "Z" and initial == "s":
                    put("Y", cost + 3 * cut, audit + "K")
        v = inserted(new)
    return min(v[s] for s in "ZA" if s in v)


def hurt(rows):
    out = []
    for c, t, role, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, x = " " if role is None else role, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else role, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired_by_hand(rows):
    damaged, out = hurt(rows), {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(r[3].encode()).hexdigest()))
        seen, messages, faults = set(), [], [0, 0, 0]
        for _, _, role, x in mine:
            visible = x.rstrip(SPACE)
            kind = 0 if not visible else 1 if (role, x) in seen else 2 if visible[-1] not in ".!?" else None
            seen.add((role, x))
            if kind is not None:
                faults[kind] += 1
            messages.append((role[:1], kind in (0, 1), kind == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit = cheapest(messages)
        lines, rest, before = [], iter(mine), ""
        for letter in audit:
            role, x = ("", "") if letter == "I" else next(rest)[2:]
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if before == "u" else "user"
            lines.append(f"{role}:{x}")
            before = role[0]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_parser_finds_the_cheapest_repair_and_the_least_audit():
    rng = random.Random(7)
    for _ in range(400):
        messages = [(rng.choice("suaax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 11))]
        messages = [(i, must, cut and not must) for i, must, cut in messages]
        assert conversation.parse(messages) == cheapest(messages)


def conversations(seed=5):
    rng = random.Random(seed)
    texts = ["a.", "b", "", None, " \n", "c!", "x" * 70 + "?", "x" * 70 + ".", "e.\x0b\t "]
    rows = [(rng.choice([1, 2, 3, None, 7]), rng.choice([0, 1, 2, 3, None, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts), "k", "x") for _ in range(300)]
    rows += [(None, None, "user", "same.", None, None)] * 60 + [(9, t, "assistant" if t % 2 else "user", f"turn {t}.", "k", "x") for t in range(300)]
    return rows + [(20, t, "user", "gone.", None, None) for t in range(200) if zlib.crc32(f"20:{t}".encode()) % 20 == 0] + [(21, 0, "user", "y" * 300_000 + ".", None, None)]


@pytest.mark.parametrize("segment", [4096, 4])
def test_repair_of_damaged_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation, "SEGMENT", segment)  # stretches of four messages: every longer conversation is joined up
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, place string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in conversation.repair_damaged(df).collect()}
    want = repaired_by_hand([r[:4] for r in rows])
    assert got == want
    assert want[20] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = conversation.report(conversation.damaged(df))
    lines = {}
    for r in conversation.repaired(conversation.damaged(df), found).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, x in want.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == x[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines.get(c, [])))
    assert conversation.repair_damaged(df.where("false")).count() == 0


# ---- whitening


def whitened_by_hand(rows):
    xs = [(i, tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    c = np.array([[float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    at = {x: row for x, row in zip(fit, c, strict=True)}
    return n, values, [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), at[x] @ vectors / np.sqrt(np.maximum(values, 1e-300))) for i, x in xs]


def embeddings(n=300, d=20):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


def test_whitening(spark):
    rows = embeddings()
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [rows[1], (None, rows[2][1])]
    odd = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan"), *rows[0][1][1:]]), (2004, [float("inf"), *rows[0][1][1:]]), (2005, [1.0, 2.0]), (2006, [1e30] * 20)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + odd], "vec_id long, embedding array<float>, x string, component string").repartition(5)
    got = whitening.whiten(df).collect()
    n, values, want = whitened_by_hand(rows)
    assert len(got) == len(rows) * 16
    assert {r["n"] for r in got} == {n} == {300}
    assert all(r["identity_error"] < 1e-12 for r in got)
    per = {}
    for r in got:
        per.setdefault(r["vec_id"], []).append(r)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-12)
    one = {i: (dev, w) for i, dev, w in want}
    signs = None
    for i, rs in per.items():
        rs = sorted(rs, key=lambda r: r["component"])[:: len(rs) // 16]
        dev, w = one[i]
        assert {r["deviation"] for r in rs} == {dev}
        mine = np.array([r["whitened"] for r in rs])
        signs = np.sign(mine * w[:16]) if signs is None else signs
        assert np.abs(mine * signs - w[:16]).max() < 1e-9


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (3, 1)]
    assert sorted(abs(r["whitened"]) for r in line) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    huge = whitening.whiten(spark.createDataFrame([(i, [float(i << 40), float(i * i)]) for i in range(1, 60)], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge if r["component"] == 1} >= {None} and all(r["identity_error"] < 1e-9 for r in huge)


def test_eigen_solver():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 8, 33, 70):
        a = rng.normal(size=(n, n))
        low = rng.normal(size=(n, max(1, n // 3)))
        wilkinson = np.diag(np.abs(np.arange(n) - n // 2) * 1.0) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        for m in (a + a.T, a @ a.T, np.eye(n), np.zeros((n, n)), np.ones((n, n)), np.diag(np.arange(n) * 1.0), low @ low.T, np.diag(10.0 ** -np.arange(n)), wilkinson):
            values, vectors = whitening.eigen(m)
            top = np.abs(m).max() or 1
            assert np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() < 1e-13 * n * top
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
            assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * n * top


def test_products_are_summed_to_double_double():
    rng = np.random.default_rng(1)
    n = 500
    x = rng.integers(-40, 40, (n, 3)) + 1_000_000
    means = [Fraction(int(s), n) for s in x.sum(axis=0)]
    high = np.array([float(m) for m in means])
    total = (np.zeros((3, 3)),) * 2
    for at in (0, 250):
        total = whitening.add_products(total, *whitening.centred(x[at : at + 250], (high, np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)]))))
    for i in range(3):
        for j in range(3):
            exact = sum((int(r[i]) - means[i]) * (int(r[j]) - means[j]) for r in x)
            assert abs(Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j])) - exact) < Fraction(1 << 18, 1 << 98)  # of sums of about 2**18
