"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A mask selects words at a
position; the hash of the selected words ignores the others, so a substituted
word leaves the seeds alone that skip it. Seeds of all benchmark items are
joined with the seeds at every position of every document. Each hit fixes an
alignment; around it, document and item are compared word by word and the best
stretch is found, a match counting +1 and a substitution -PENALTY. A stretch is
an overlap if it scores half the item's words, or `least` if that is less; an
item of fewer than SPAN words has to be there whole.

The masks lose no such stretch: one without four words in a row, and without
three and two with one word between, scores 3 at most, and at least 5 are
needed. Items of fewer words than the first mask has, if there are any, get a
mask of their own length.

The seeds of the benchmark are counted first: up to BROADCAST_SEEDS they are
broadcast, beyond that both sides are shuffled by seed. The alignments that the
seeds give are stored and counted: up to BROADCAST_LINES they are broadcast to
the documents, whose texts then are not shuffled and are cut into words anew only
where there is an alignment; beyond that the texts are shuffled.

Defined results: null and empty texts or items match nothing; repeated items
count once per item_id and text; repeated documents each get their overlaps;
decontaminate() judges each row by itself, whatever its id; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import free_name, materialize, with_row_key

# Items below SPAN words have to match whole; the selected positions of each mask.
SPAN = 10
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4, 5))
PENALTY = 2
LEAST = 12
#: Benchmark seeds that are broadcast, at most (about 50 MB); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Alignments (document, item, shift) that are broadcast, at most (about 50 MB).
BROADCAST_LINES = 1_000_000


def word_hashes(text: str) -> Column:
    """Hashes of the words of a text; null for null."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(h: str, size: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """Seed hashes, mask after mask; each mask has as many as there are words, null where it reaches beyond the last."""

    def of(mask: tuple[int, ...]) -> Column:
        at = F.sequence(F.lit(0), F.col(size) - 1)
        inside = lambda i: i < F.col(size) - mask[-1]
        return F.transform(at, lambda i: F.when(inside(i), F.xxhash64(F.lit(str(mask)), *(F.get(F.col(h), i + p) for p in mask))))

    return F.concat(*(of(mask) for mask in masks))


def _with_seeds(df: DataFrame, keep: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    sized = df.withColumn("_n", F.size("_h")).where(F.col("_n") > 0)
    out = sized.select(*keep, "_n", F.posexplode(seeds("_h", "_n", masks)).alias("_p", "seed")).where("seed is not null")
    return out.select(*keep, F.pmod("_p", "_n").alias("pos"), "seed")


def find_overlaps(docs: DataFrame, bench: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document id and item that overlap: doc id, item id, score, words matched of the item, item's words, first word in the document."""
    items = bench.select(F.col(item_col).alias("item"), F.col(item_text).alias("_t")).where("_t is not null").distinct().withColumn("_h", word_hashes("_t")).select("item", "_h").where(F.size("_h") > 0)
    short = items.select(F.size("_h").alias("n")).where(F.col("n").between(1, len(MASKS[0]) - 1)).distinct().collect()
    masks = (*MASKS, *(tuple(range(r.n)) for r in short))
    item_seeds = _with_seeds(items, ["item"], masks).select("item", F.col("pos").alias("q"), "seed")
    small = item_seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).where("_t is not null")
    hashed = texts.withColumn("_h", word_hashes("_t")).select("id", "_h")
    hits = _with_seeds(hashed, ["id"], masks).join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    lines = materialize(hits.select("id", "item", (F.col("pos") - F.col("q")).alias("shift")).distinct(), "lines")
    few = lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    both = texts.join(F.broadcast(lines) if few else lines, texts["id"].eqNullSafe(lines["id"])).drop(lines["id"])
    both = both.withColumn("dh", word_hashes("_t")).drop("_t")
    # an item has at least one seed for four words, so few seeds are few and short items
    other = items.withColumnRenamed("_h", "ih").withColumnRenamed("item", "item2")
    both = both.join(F.broadcast(other) if small else other, F.col("item").eqNullSafe(F.col("item2"))).drop("item2")
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(F.size("ih"), F.size("dh") - F.col("shift")) - 1
    equal = F.transform(F.sequence(lo, hi), lambda q: F.get("ih", q) == F.get("dh", q + F.col("shift")))
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"), F.lit(0).alias("hits"))

    def step(s: Column, e: Column) -> Column:
        cur = F.greatest(F.lit(0), s["cur"] + F.when(e, 1).otherwise(-PENALTY))
        return F.struct(cur.alias("cur"), F.greatest(s["best"], cur).alias("best"), (s["hits"] + e.cast("int")).alias("hits"))

    size = F.size("ih")
    need = F.when(size < SPAN, size).otherwise(F.least(F.lit(least), F.ceil(size / 2)))
    scored = both.where(hi >= lo).withColumn("s", F.aggregate(equal, zero, step)).where(F.col("s.best") >= need)
    best = scored.groupBy("id", "item").agg(
        F.max(F.struct("s.best", "s.hits", -F.col("shift"), F.size("ih").alias("words"))).alias("m")
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("m.best").alias("score"),
        F.col("m.hits").alias("matched"),
        F.col("m.words").alias("item_words"),
        (-F.col("m.col3")).alias("start"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """docs without the rows that have an overlap, each row by itself: id_col may be null or repeated.

    Up to BROADCAST_LINES such rows are broadcast, and the texts are not shuffled; more are joined by shuffle.
    """
    key = free_name(docs, "_row")
    keyed = with_row_key(docs, key)
    found = materialize(find_overlaps(keyed, bench, id_col=key, **kw).select(F.col(key).alias("_bad")).distinct(), "found")
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    return keyed.join(found, keyed[key] == found["_bad"], "left_anti").drop(key)
