"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in built-in functions only.

A text is the multiset of its paragraphs: the non-empty pieces between line ends and sentence ends (``[.!?]`` and a
space). The md5 of a paragraph gives two 60-bit words and from them a vector of 123 entries: 1, the two words
modulo 2**60, and their 120 bits, each an entry modulo 2**19. A fingerprint is the sum of these vectors, so it
doesn't depend on order, and a paragraph is put in or taken out by adding or subtracting its vector (``combine``).
Three 19-bit entries share a long, each with a guard bit above it that takes the carry and is cleared after each
addition; no sum can overflow, however long the text.

The bits also serve as signs: 2 * count - paragraphs is the sum of random signs, so the cosine of two fingerprints'
sign sums estimates how much of their paragraphs two texts share (``likeness``; standard error about 0.09 near 0).

Defined results: null and empty texts have the empty multiset (all zero); two fingerprints that are equal have
likeness 1, an empty and another one 0; rows that agree in doc_id follow one another by text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from casegraph.llm.common import same_key, text_or_empty

WORDS, SHIFTS, WIDTH = 2, 20, 20
#: Lowest bits of the three entries of a long; all their bits without the guard bits; the guard bits.
ONES = sum(1 << (WIDTH * i) for i in range(3))
ENTRIES = ONES * ((1 << (WIDTH - 1)) - 1)
GUARDS = ONES << (WIDTH - 1)
M60 = (1 << 60) - 1
#: Cells of the doc_id axis for finding the next document: rows aimed at, and most of them; ids drawn for a border; borders that are looked at together.
CELL_ROWS, MOST_CELLS, DRAWN, FAN = 1024, 1 << 17, 16, 64


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\\n|[.!?] ", -1), lambda x: F.length(x) > 0)


def paragraph_words(text: Column) -> Column:
    """The two 60-bit words of each paragraph."""
    digests = F.transform(paragraphs(text), lambda x: F.md5(x.cast("binary")))
    word = lambda x, at: F.conv(F.substring(x, at, 15), 16, 10).cast("long")
    return F.transform(digests, lambda x: F.struct(word(x, 1).alias("a"), word(x, 16).alias("b")))


def with_lanes(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the fingerprint as an array of 43 longs: the number of paragraphs, two dense sums, 40 longs of three entries."""
    words = df.withColumn("_w", paragraph_words(text)).withColumns({"_a": F.col("_w.a"), "_b": F.col("_w.b")})

    dense = [F.expr(f"aggregate({c}, 0L, (s, x) -> (s + x) & {M60}L)") for c in ("_a", "_b")]
    bits = [F.expr(f"aggregate({c}, 0L, (s, x) -> (s + (shiftright(x, {k}) & {ONES}L)) & {ENTRIES}L)") for c in ("_a", "_b") for k in range(SHIFTS)]
    return words.withColumn(name, F.array(F.size("_w").cast("long"), *dense, *bits)).drop("_w", "_a", "_b")


def to_hex(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """The fingerprint (as lanes) of the multiset sum of two texts, or of ``a`` without ``b``."""
    sign = -1 if remove else 1

    def one(x: Column, y: Column, i: int) -> Column:
        if i == 0:
            return x + sign * y
        if i <= WORDS:
            return (x + (F.lit(M60 + 1) - y if remove else y)).bitwiseAND(F.lit(M60))
        # the guard bits lend to each entry, so that no entry borrows from its neighbour
        return ((x.bitwiseOR(F.lit(GUARDS)) - y) if remove else (x + y)).bitwiseAND(F.lit(ENTRIES))

    return F.array(*(one(a[i], b[i], i) for i in range(1 + WORDS + WORDS * SHIFTS)))


def signs(lanes: Column) -> Column:
    """The 120 sums of signs: 2 * count - paragraphs, in the range that an entry can hold."""
    low, half = (1 << (WIDTH - 1)) - 1, 1 << (WIDTH - 2)
    counts = F.flatten(F.transform(F.slice(lanes, 2 + WORDS, WORDS * SHIFTS), lambda x: F.array(*(F.shiftright(x, WIDTH * i).bitwiseAND(F.lit(low)) for i in range(3)))))
    return F.transform(counts, lambda c: (c * 2 - lanes[0] + half).bitwiseAND(F.lit(low)) - half)


def likeness(a: Column, b: Column, signs_a: Column, signs_b: Column) -> Column:
    """0 to 1, from the fingerprints (lanes) and their signs alone."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)
    norm = F.sqrt(dot(signs_a, signs_a).cast("double") * dot(signs_b, signs_b).cast("double"))
    cosine = F.when(norm > 0, dot(signs_a, signs_b) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.round(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)), 6))


def borders_below(x: Column, borders: list[int]) -> Column:
    """How many of the sorted ``borders`` are not above ``x``, found as in a tree of FAN branches; null for null."""
    depth = 1
    while FAN**depth < len(borders):
        depth += 1

    def nested(v: list, d: int) -> list:
        return v if d == 1 else [nested(v[i : i + FAN ** (d - 1)], d - 1) for i in range(0, len(v), FAN ** (d - 1))]

    def least(node: Column, d: int) -> Column:
        return node[0] if d == 1 else least(node[0], d - 1)

    def count(node: Column, d: int) -> Column:
        if d == 1:
            return F.size(F.filter(node, lambda b: b <= x))
        branches = F.size(F.filter(node, lambda n: least(n, d - 1) <= x))
        return F.transform(F.array(branches), lambda i: F.when(i > 0, (i - 1) * FAN ** (d - 1) + count(F.get(node, i - 1), d - 1)).otherwise(0))[0]

    tree = F.from_json(F.lit(json.dumps(nested(borders, depth))), "array<" * depth + "long" + ">" * depth)
    return F.when(x.isNotNull(), count(tree, depth))


def in_cells(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """The rows with ``cell`` and ``guest``, and the window in which ``lead`` finds the row next in (doc_id, text hash); after the last comes the first.

    The doc_id axis is cut at every DRAWN-th of some ids drawn by hash, in about MOST_CELLS cells at most, so that they
    hold about as many rows however the ids lie; each cell is sorted alone, and each cell's first row
    also stands, as a guest, at the end of the cell before. Needs columns doc_id (long) and thash."""
    cells = max(1, min(MOST_CELLS, docs.count() // CELL_ROWS))
    borders = []
    if cells > 1:  # ids, not rows: one id in many rows is one border
        drawn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 40)) < (1 << 40) * cells * DRAWN // max(1, docs.count())
        ids = docs.where(F.col("doc_id").isNotNull() & drawn).select("doc_id").distinct()
        nth = ids.withColumn("nth", F.row_number().over(Window.orderBy("doc_id")))  # over DRAWN * MOST_CELLS ids, give or take a few
        borders = [r[0] for r in nth.where(F.col("nth") % DRAWN == 0).select("doc_id").orderBy("doc_id").collect()]
    cell = F.coalesce(borders_below(F.col("doc_id"), borders), F.lit(-1)).cast("long").alias("cell")
    placed = docs.withColumn("cell", cell).withColumn("guest", F.lit(0))
    heads = docs.select(cell, F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "thash").alias("head")).groupBy("cell").agg(F.min("head").alias("head"))
    last = Window.partitionBy().orderBy("cell")  # over the cells' heads: 2 * MOST_CELLS rows at most
    before = heads.select("head", F.coalesce(F.lag("cell").over(last), F.max("cell").over(Window.partitionBy())).alias("before"))
    before = before.select(F.col("head.doc_id").alias("doc_id"), F.col("head.thash").alias("thash"), "before")
    guests = docs.join(F.broadcast(before), same_key(docs, before, "doc_id", "thash")).select(*(docs[c] for c in docs.columns), before["before"].alias("cell"), F.lit(1).alias("guest"))
    return placed.unionByName(guests), Window.partitionBy("cell").orderBy("guest", F.col("doc_id").asc_nulls_first(), "thash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lanes) of each row: the general form, for equality, insertion and deletion."""
    return with_lanes(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")), F.col("_t"), "lanes").select("doc_id", "lanes")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half comes from the next document, and their likeness."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("thash", F.xxhash64("text"))
    placed, order = in_cells(slim)
    rows = with_lanes(placed, F.col("text"), "fp")
    led = rows.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).where(F.col("guest") == 0)
    half = F.expr("n_chars div 2").cast("int")
    cut = led.withColumn("n_chars", F.length("text").cast("long"))
    cut = cut.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_lanes(cut.select("doc_id", "n_chars", "edited", "fp", "next_fp"), F.col("edited"), "efp")
    signed = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp", "next_fp", *(signs(F.col(c)).alias(f"s_{c}") for c in ("fp", "efp", "next_fp")))
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp"), F.col("s_fp"), F.col("s_efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), F.col("s_fp"), F.col("s_next_fp")).alias("near_next"),
    )
