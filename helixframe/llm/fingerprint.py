"""Document fingerprints: a threshold-scaled sketch of word shingles, in SQL functions only.

Every shingle hash below a fixed fraction of the hash range is retained, whatever
the text's length, so sketches of parts merge (``merge``) and containment can be
estimated between very unequal documents. A text whose hashes all lie above the
fraction retains its smallest one, so that short texts keep an identity; such a
hash gives way when sketches merge, so the merged one is the sketch of both texts'
shingles together.

Words are runs of anything but blank, tab and line ends, lower-cased; a shingle
is five of them, and a text of one to four words is a single one. Null and empty
texts have no shingles and an empty fingerprint. Two empty fingerprints are alike
(1), an empty and another are not (0).

The next document in ascending doc_id is found with one shuffle of the texts:
rows go to ranges of ids, and the first row of each range goes to the range
before as well. Null ids come first, ties of ids are ordered by text, and the
last document's next is the first one (itself, if it is alone). Repeated rows each
give a row; an empty table gives no rows; very long texts are sketched whole;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, partitions_of

SHINGLE = 5
#: One in so many hashes is retained.
SCALE = 4
_BLANKS = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """The hash of every word shingle; lambda arguments keep the words from being built again for each one."""
    words = F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != "")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    none = F.array().cast("array<bigint>")
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, none).when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(hashed(w))), F.lit(0))


def _retained(hashes: Column, scale: int) -> Column:
    """The hashes in the lowest 1/``scale`` of the range, or else the smallest one."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    return F.when((F.size(hashes) > 0) & ~F.exists(hashes, lambda h: h < limit), F.array(F.array_min(hashes))).otherwise(F.filter(hashes, lambda h: h < limit))


def sketch(text: Column, scale: int = SCALE, k: int = SHINGLE) -> Column:
    """The sorted distinct hashes in the lowest 1/``scale`` of the range, or else the smallest one."""
    return F.get(F.transform(F.array(shingle_hashes(text, k)), lambda hs: F.array_sort(F.array_distinct(_retained(hs, scale)))), F.lit(0))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles that either of two sketches of one ``scale`` stands for."""
    return F.get(F.transform(F.array(F.array_sort(F.array_union(a, b))), lambda hs: _retained(hs, scale)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, F.hex), ",")


def _constants(values: list, kind: str) -> Column:
    """An array of numbers as one constant, which adds one expression to a plan however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def with_next(rows: DataFrame, order: str, tie: str, made: dict[str, Column]) -> DataFrame:
    """Each row with the columns ``made`` and ``next``, a struct of ``tie`` and of them of the row that follows in order, cyclically.

    Columns are made after the shuffle, which so moves the rows alone.

    The ranges' bounds are quantiles of the order column, as many as a few times
    the shuffle partitions; that list is all that comes to the driver.
    """
    ranges = 4 * partitions_of(rows.sparkSession)
    marks = F.percentile_approx(order, _constants([i / ranges for i in range(1, ranges)] or [0.5], "double"), 100 * ranges)
    got = rows.agg(F.min(order).alias("least"), F.count_if(F.col(order).isNull()).alias("nulls"), marks.alias("marks")).first()
    least = None if got["nulls"] else got["least"]
    bounds = sorted({b for b in got["marks"] or [] if b > got["least"] or got["nulls"]})
    # The range of an id is the number of bounds up to it, by binary search.
    at, known = F.col(order), _constants(bounds, "bigint")
    powers = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fits = lambda i: (i <= len(bounds)) & (F.get(known, i - 1) <= at)
    part = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n)) if bounds else F.lit(0)
    first = F.coalesce((part > 0) & (F.get(known, part - 1) == at), F.lit(False))
    place = lambda p, guest: F.struct(p.cast("int").alias("part"), F.lit(guest).alias("guest"))
    places = F.array(place(part, 0), F.when(first, place(part - 1, 1)), F.when(at.eqNullSafe(F.lit(least)), place(F.lit(len(bounds)), 2)))
    placed = rows.withColumn("__at", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("*", "__at.part", "__at.guest").drop("__at")
    following = F.lead(F.struct(tie, *made)).over(W.partitionBy("part").orderBy("guest", F.col(order).asc_nulls_first(), tie))
    return placed.repartition("part").withColumns(made).withColumn("next", following).filter("guest = 0").drop("part", "guest")


def with_edited(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch, next_sketch, edited: the text whose last half of code points is the next document's first."""
    half = F.expr("cast(length(text) div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    return with_next(id_and_text(docs), "doc_id", "text", {"sketch": sketch(F.col("text"), scale)}).select("doc_id", "text", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))


def compare_edited(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    both = with_edited(docs, scale).withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return both.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
