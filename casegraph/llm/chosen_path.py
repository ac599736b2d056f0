"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles (``words`` consecutive words, lower case; all words where there are fewer).
Documents with equal sets form a class; only classes are joined. In each run a set samples about ``beta`` of its
shingles by a hash that all sets share, then again below each of them: the sampled shingles are a path, and two
similar sets follow a common path with a probability that their similarity bounds from below (``survival``). Sets on
one path are a bucket; in a bucket of up to ``small`` sets all pairs are compared, exactly, by their shingles. Runs
repeat until the recall aimed at: their number follows from the survival of a pair at the threshold.

A bucket of more sets mostly stems from a passage that many texts share, which sampling splits badly. The sets of such
buckets are pooled and joined exactly instead: shingles are counted in the pool, and each set stands in the buckets of
its rarest shingles, as many as it can lack and still reach the threshold, and one more. Any two similar sets
share one of these, so no pair of the pool is lost. A bucket that is still large, as its sets are alike, is dealt to
chunks, each compared within itself and with a few sets that all chunks get (pivots); when their links are merged, the
sets outside the bucket's largest component are compared with all its sets. No cap drops a pair.

After the first runs, links are merged to components; later runs look only at buckets that hold sets of more than one
component. A bucket yields the links of a spanning forest, not its pairs; buckets with the same members are looked at once.

At last the links of a class are counted, exactly: each component's sets are dealt to cells of at most about
``cell`` by ``cell`` sets, and each task counts links by class without emitting pairs.

Defined results: null and empty texts (no word) are one class without shingles, linked to nothing else; texts
that are equal up to case and white space are of one class; a doc_id with several texts stands in several
classes; repeated rows count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.llm.common import by_batch, materialise, mix64, range_hashes, same_key, slices, text_bytes, text_or_empty
from casegraph.operators.components import components, spread_join

_U = np.uint64
#: Bytes of a shingle's hash that are compared.
WIDE = 5
SEED = 0xD1B54A32D192ED03


def survival(threshold: float, beta: float, depth: int) -> float:
    """A lower bound of the chance that two sets at the threshold share a path of ``depth`` shingles in a run.

    Of the larger set at least a share of ``threshold`` is common, so common samples are Poisson with mean beta * threshold."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-beta * threshold * p)
    return p


def runs_for(recall: float, threshold: float, beta: float, depth: int = 2) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, beta, depth))))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted by text and hash, and the bounds of each text's in them (one more than texts)."""
    tidy = [b" ".join(t.split()) for t in texts]
    data = np.frombuffer(b"\n".join(tidy) + b"\n", dtype=np.uint8)
    gap = (data == 32) | (data == 10)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in tidy])]
    n_words = np.diff(np.searchsorted(starts, begin))
    n = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.r_[0, np.cumsum(n_words)][:-1]
    at = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n) + first[owner]
    last = np.minimum(at + words - 1, first[owner] + n_words[owner] - 1)
    h = range_hashes(data, starts[at], ends[last])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def class_keys(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes a set: sums of two scramblings of its shingles."""
    total = lambda x: np.diff(np.r_[_U(0), np.cumsum(x, dtype=_U)][bounds])
    pair = np.stack([total(mix64(h)), total(mix64(h ^ _U(SEED)))], axis=1)
    return [p.tobytes() for p in mix64(pair + np.diff(bounds).astype(_U)[:, None] * _U(SEED | 1))]


def _limits(bounds: np.ndarray, beta: float) -> np.ndarray:
    """Hashes below it are sampled: a share of beta / size of each set."""
    share = np.minimum(beta / np.maximum(np.diff(bounds), 1), 1.0)
    return np.where(share >= 1, _U(2**64 - 1), (share * float(2**63)).astype(_U) * _U(2))


def step(h: np.ndarray, bounds: np.ndarray, limits: np.ndarray, who: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Go on from paths (of the sets ``who``): the sets and paths one sampled shingle further."""
    n = np.diff(bounds)[who]
    source = np.repeat(np.arange(len(who)), n)
    at = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n) + bounds[who][source]
    u = mix64(h[at] ^ path[source])
    hit = u <= limits[who][source]
    return who[source[hit]], mix64(u[hit] + path[source[hit]] * _U(3))


def paths(h: np.ndarray, bounds: np.ndarray, beta: float, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets and their paths of two shingles in a run."""
    limits = _limits(bounds, beta)
    root = mix64(np.array([run + 1], dtype=_U) * _U(SEED))[0]
    who = np.arange(len(bounds) - 1)
    who, path = step(h, bounds, limits, who, np.full(len(who), root, dtype=_U))
    return step(h, bounds, limits, who, path)


def _sign(words: int, beta: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), text_bytes(b.column("text"))
            for a, z in slices([len(t) for t in texts], 1 << 21):
                h, bounds = shingles(texts[a:z], words)
                keys = [[] for _ in range(z - a)]
                for r in range(runs):
                    for i, p in zip(*(x.tolist() for x in paths(h, bounds, beta, r)), strict=True):
                        keys[i].append({"run": r, "key": p - (1 << 63)})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, z - a), b.column("thash").slice(a, z - a), pa.array(class_keys(h, bounds), pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), pa.array(keys, pa.list_(pa.struct([("run", pa.int32()), ("key", pa.int64())])))],
                    names=["doc_id", "thash", "ck", "n", "paths"],
                )

    return run


def _sets(words: int):
    """(ck, set) of the rows whose text is the class's."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b.column("text"))
        out, want = [], b.column("ck").to_pylist()
        for a, z in slices([len(t) for t in texts], 1 << 21):
            h, bounds = shingles(texts[a:z], words)
            for i, ck in enumerate(class_keys(h, bounds)):
                if ck == want[a + i]:
                    out.append((ck, h[bounds[i] : bounds[i + 1]].view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["ck", "set"])

    return by_batch(run)


def unpack_set(data: bytes) -> np.ndarray:
    x = np.zeros((len(data) // WIDE, 8), dtype=np.uint8)
    x[:, :WIDE] = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDE)
    return x.reshape(-1).view(_U)


def alike(sets: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold: a symmetric matrix, False on the diagonal."""
    parts = [unpack_set(s) for s in sets]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    tokens, where = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(where, minlength=len(tokens))
    shared = count > 1  # a token of one set only adds to no pair
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(parts)), size)
    live = shared[where]
    owner, col = owner[live], place[where[live]]
    both = np.zeros((len(parts), len(parts)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    owner, col, n_cols = owner[order], col[order], int(shared.sum())
    for a in range(0, n_cols, 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        x = np.zeros((len(parts), min(4096, n_cols - a)), dtype=np.float32)
        x[owner[lo:hi], col[lo:hi] - a] = 1
        both += x @ x.T
    either = size[:, None] + size[None, :] - both
    out = (both >= threshold * either - 1e-6) & (either > 0)
    np.fill_diagonal(out, False)
    return out


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Consecutive rows with equal values in ``names``: the values and the other columns as lists. Rows must be sorted."""
    held_key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        rest = [c for c in b.schema.names if c not in names]
        keys = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
        cols = [b.column(c).to_pylist() for c in rest]
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] == held_key:
                for x, c in zip(held, cols, strict=True):
                    x.extend(c[at:end])
            else:
                if held is not None:
                    yield held_key, held
                held_key, held = keys[at], [c[at:end] for c in cols]
            at = end
    if held is not None:
        yield held_key, held


def _forest(threshold: float):
    """The links of a spanning forest of each cell's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, (cks, sets) in groups_of(batches, ["key", "i", "j"]):
            near = alike(sets, threshold)
            left = np.ones(len(cks), dtype=bool)
            for k in range(len(cks)):
                if not left[k]:
                    continue
                left[k], front = False, [k]
                while front:
                    x = front.pop()
                    for y in np.flatnonzero(near[x] & left).tolist():
                        left[y] = False
                        front.append(y)
                        a.append(cks[x])
                        b.append(cks[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _count(threshold: float):
    """The links of each set in its cell; a pair whose sets are both of one chunk is counted in the diagonal cell only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        for (_, i, j), (cks, sets, members, chunk) in groups_of(batches, ["component", "i", "j"]):
            near = alike(sets, threshold)
            side = np.array(chunk)
            if i != j:
                near &= side[:, None] != side[None, :]
            weight = np.array(members, dtype=np.int64)
            out.extend(zip(cks, near.sum(axis=1).tolist(), (near @ weight).tolist(), strict=True))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["ck", "classes", "docs"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["ck", "classes", "docs"])

    return run


def in_cells(rows: DataFrame, size: str, cell: int) -> DataFrame:
    """Deal the rows of a group (of ``size`` rows) to cells (i, j), i <= j, so that any two of its rows meet in one."""
    dealt = rows.withColumn("chunks", F.ceil(F.col(size) / cell).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "ck"), F.col("chunks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "other")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shingle: (ck, n, token), n being the size of the set."""
    for b in batches:
        cks, sets = b.column("ck").to_pylist(), [unpack_set(x) for x in b.column("set").to_pylist()]
        for a, z in slices([len(x) for x in sets], 1 << 18):
            size = [len(x) for x in sets[a:z]]
            own = np.repeat(np.arange(z - a), size)
            yield pa.RecordBatch.from_arrays([pa.array(cks[a:z], pa.binary()).take(pa.array(own)), pa.array(np.repeat(size, size), pa.int32()), pa.array(np.concatenate(sets[a:z]).view(np.int64))], names=["ck", "n", "token"])


def rarest(pool: DataFrame, sets: DataFrame, threshold: float, small: int) -> DataFrame:
    """(run, key, ck): each set of the pool at its rarest shingles; any two sets that reach the threshold share one.

    Only shingles of more than ``small`` sets are told apart by their counts; all others come first, by their hashes."""
    tokens = materialise(sets.join(pool, "ck", "left_semi").mapInArrow(_tokens, "ck binary, n int, token long"), "tokens")
    common = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > small), "common")  # a few rows: no shuffle of the tokens
    place = F.row_number().over(Window.partitionBy("ck").orderBy(F.coalesce("df", F.lit(0)), "token"))
    ranked = tokens.join(common, "token", "left").withColumn("place", place)
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select(F.lit(-1).alias("run"), F.xxhash64(F.lit(7), "token").alias("key"), "ck")


def unlike(steps: DataFrame, small: int) -> DataFrame:
    """(key, size) of the buckets of rows (run, key, ck, in) with sets of two or more components ``in``, but for the large
    ones of runs, whose sets are pooled; of those with the same members one is enough."""
    sized = steps.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("run").alias("run"), F.min("in").alias("lo"), F.max("in").alias("hi"), F.bit_xor(F.xxhash64("ck")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "ck")).alias("who2"))
    return sized.where(F.col("lo") != F.col("hi")).where((F.col("run") < 0) | (F.col("size") <= small)).groupBy("size", "who", "who2").agg(F.min("key").alias("key")).select("key", "size")


def compared(cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the spanning links of each cell of rows (key, i, j, ck)."""
    full = cells.join(sets, "ck").select("key", "i", "j", "ck", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(full.mapInArrow(_forest(threshold), "a binary, b binary"), "bucket-links")


def in_chunks(buckets: DataFrame, small: int, pivots: int = 32) -> DataFrame:
    """The rows (key, ck, size) dealt to chunks of about ``small`` sets; some ``pivots`` of a larger bucket stand in all its chunks."""
    dealt = buckets.withColumn("chunks", F.ceil(F.col("size") / small).cast("int"))
    own = F.array(F.pmod(F.xxhash64(F.lit(3), "ck"), F.col("chunks")).cast("int"))
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(4), "ck"), F.ceil(F.col("size") / pivots)) == 0)
    return dealt.select("key", "ck", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)).alias("i")).withColumn("j", F.col("i"))


def what_is_left(buckets: DataFrame, found: DataFrame, small: int) -> DataFrame:
    """Cells (key, i, j, ck) in which each set of a large bucket outside its largest component meets all its sets."""
    rows = materialise(buckets.where(F.col("size") > small).join(found, "ck", "left").select("key", "ck", F.coalesce("component", "ck").alias("in")), "large")
    parts = rows.groupBy("key", "in").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("in", F.struct("n", "in")).alias("most"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    half = small // 2
    dealt = rows.join(parts, "key").withColumns({"rows_of": F.ceil(F.col("others") / half).cast("int"), "cols_of": F.ceil(F.col("all") / half).cast("int")})
    at = lambda n: F.pmod(F.xxhash64(F.lit(5), "ck"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return dealt.where(F.col("in") != F.col("most")).select("key", at("rows_of").alias("i"), every("cols_of").alias("j"), "ck").unionByName(dealt.select("key", every("rows_of").alias("i"), at("cols_of").alias("j"), "ck"))


def groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, beta: float = 1.5, small: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of each row (doc_id, thash, ck); of each class (ck, rep, at, n_copies), its least id, its first document and its number of
    documents; of each class with links (ck, component); the sets (ck, set) of all that may have any."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_or_empty(text_col)).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("thash"))
    runs = runs_for(recall, threshold, beta)
    rows = materialise(slim.mapInArrow(_sign(words, beta, runs), "doc_id long, thash long, ck binary, n int, paths array<struct<run int, key long>>"), "signed")
    classes = materialise(rows.groupBy("ck").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "thash")).alias("at"), F.count(F.lit(1)).alias("n_copies"), F.first("paths").alias("paths")), "classes")
    steps = classes.select("ck", "at", F.explode("paths").alias("p")).select("ck", "at", "p.run", "p.key")
    # the sets of the classes that share any bucket; copies are classes, so no bucket is large by them
    shared = materialise(steps.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    steps = materialise(steps.join(shared, "key", "left_semi").select("run", "key", "ck", "at"), "steps")  # most steps lead to a bucket of one
    wanted = steps.select("ck", "at.doc_id", "at.thash").distinct()
    sets = materialise(slim.join(wanted, same_key(slim, wanted, "doc_id", "thash")).select("ck", "text").mapInArrow(_sets(words), "ck binary, set binary").groupBy("ck").agg(F.first("set").alias("set")), "sets")
    steps = steps.select("run", "key", "ck")
    early = max(1, runs // 3)
    first = steps.where(F.col("run") < early)
    large = shared.where(F.col("size") > small)
    if not large.isEmpty():
        first = first.unionByName(materialise(rarest(steps.join(large, "key", "left_semi").select("ck").distinct(), sets, threshold, small), "rarest"))
    first = first.withColumn("in", F.col("ck"))
    members = lambda of: materialise(of.select("key", "ck").join(unlike(of, small), "key"), "buckets")
    buckets = members(first)
    links = compared(in_chunks(buckets, small), sets, threshold)
    found = components(links).withColumnRenamed("node", "ck")
    if not buckets.where(F.col("size") > small).isEmpty():
        links = links.unionByName(compared(what_is_left(buckets, found, small), sets, threshold))
        found = components(links).withColumnRenamed("node", "ck")
    if runs > early:
        late = steps.where(F.col("run") >= early).join(found, "ck", "left").select("run", "key", "ck", F.coalesce("component", "ck").alias("in"))
        links = links.unionByName(compared(in_chunks(members(late), small), sets, threshold))
        found = components(links).withColumnRenamed("node", "ck")
    return rows.select("doc_id", "thash", "ck"), classes.select("ck", "rep", "at", "n_copies"), found, sets


def classes_and_links(docs: DataFrame, threshold: float = 0.8, cell: int = 512, **options) -> tuple[DataFrame, DataFrame]:
    """Of each row (doc_id, thash, ck); of each class (ck, class_id, n_links, n_copies): the least id of its group, the documents
    of other classes that it is similar to, and the documents of its own."""
    rows, facts, found, sets = groups(docs, threshold=threshold, **options)
    sized = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    facts = facts.drop("at")
    linked = found.join(sized, "component").join(facts, "ck").join(sets, "ck")
    cells = in_cells(linked, "size", cell).select("component", "i", "j", "ck", "set", F.col("n_copies").alias("members"), "chunk").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = cells.mapInArrow(_count(threshold), "ck binary, classes long, docs long").groupBy("ck").agg(F.sum("docs").alias("n_links"))
    head = found.join(facts, "ck").groupBy("component").agg(F.min("rep").alias("class_id"))
    of = materialise(found.join(head, "component").join(counted, "ck", "left").select("ck", "class_id", "n_links"), "groups")
    each = facts.join(of, "ck", "left").select("ck", F.when(F.col("class_id").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows, each


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of each row: class_id is the least doc_id that links lead to; n_links counts the other documents with a similarity of at least the threshold, copies among them."""
    rows, each = classes_and_links(docs, **options)
    met = spread_join(rows, "ck", each.withColumnRenamed("ck", "of"), "of", "inner", salts=8)  # copies of one text may be a third of all
    return met.select("doc_id", "class_id", (F.col("n_links") + F.col("n_copies") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, of one document of each group: the least doc_id (null first), then
    the least hash of the text; of repeated rows one. What stays is decided on the first documents of classes; links aren't counted; texts are joined once."""
    rows, classes, found, _ = groups(docs, **options)
    first = classes.join(found, "ck", "left").groupBy(F.coalesce("component", "ck").alias("group")).agg(F.min("at").alias("first")).select("first.doc_id", "first.thash")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("thash"))
    kept = keyed.join(first, same_key(keyed, first, "doc_id", "thash"), "left_semi")
    if not rows.groupBy("doc_id", "thash").count().where("count > 1").isEmpty():
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "thash").orderBy("doc_id"))).where("nth = 1")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
