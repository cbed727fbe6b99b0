"""Near-duplicate classes by a grouped prefix join on word shingles.

Two documents link when the Jaccard similarity of their sets of distinct 5-word
shingles reaches ``PERCENT`` hundredths. The steps:

1. Equal texts collapse to the one of the smallest doc_id.
2. Every block of documents sends its shingles to key buckets and gets their
   document frequencies back, so each set can be put in one global order, rarest
   first. Two linked sets share a shingle within the first ``n - ceil(0.75 n) + 1``
   of each; one that no other text holds can't be shared, so most texts have no
   shared shingle in their prefix and are settled.
3. Documents with identical prefixes and size form a group. Groups meet on prefix
   shingles, filtered by size and by what the positions leave for the overlap.
4. First each group meets only one group per shingle (that with the fewest
   unshared shingles, the likely original of near copies); verified links give
   classes. Then all pairs of groups that share a prefix shingle and hold members
   of different classes are expanded and verified. Pairs within a class need no
   look, so a class of thousands of near copies isn't expanded into its pairs,
   and no link between classes is lost.

Shingles are compared as 64-bit hashes (a chance of about 2**-64 a pair to differ
from their text). A-Z are folded; words are runs of anything but blank, tab and
line ends; a text of one to four words has one shingle, the whole of it; null,
empty and blank texts have none and link to nothing. Repeated rows each give a
row; rows that repeat an id count as one document; a null id is an id that sorts
before all others. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import byte_hash
from .blocks import KEYS, NULL_ID, ROSTER, TEXT_KEY, blocked, buckets_of, firsts, is_first, key_rows, pack, pair_keys, roster_from, roster_of, rosters, split_keys, unpack
from .common import bounded, join_hot, quoted, release, settle, shared_path
from .components import components

SHINGLE = 5
PERCENT = 75
_NODES_PER_FILE = 50_000

class Sets:
    """The shingle sets of the texts in a block that stand for themselves and their copies."""

    def __init__(self, table: pa.Table, wanted: np.ndarray):
        table = table.filter(pa.array(is_first(table, wanted)))
        _, once = np.unique(pair_keys(table["doc_id"].to_numpy(), table["h"].to_numpy()), return_index=True)
        table = table.take(pa.array(once))
        self.table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        data, at = byte_hash.bytes_of(self.table["text"])
        _, _, hashes, word_at = byte_hash.words(data, at)
        shingles, at = byte_hash.shingles(hashes, word_at, SHINGLE)
        for a, b in zip(at[:-1], at[1:]):
            shingles[a:b].sort()
        new = np.ones(len(shingles), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        new[at[:-1][at[:-1] < len(new)]] = True
        self.values, self.at = shingles[new], np.concatenate([[0], np.cumsum(new)])[at]
        release()


def _send_shingles(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, wanted: pa.Table) -> pa.Table:
        values, counts = np.unique(Sets(table, roster_of(wanted)).values, return_counts=True)
        order, lows, at = split_keys(values, buckets)
        return key_rows(key[0].as_py(), lows, at, np.minimum(counts[order], 255).astype(np.uint8))

    return run


def _frequencies(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A class that grows with the document frequency, exact below 128, for each key sent."""
    keys, at = unpack(table["keys"], "<u4")
    counts, _ = unpack(table["more"], "u1")
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    total = np.add.reduceat(counts[order].astype(np.int64), begin)
    rank = np.where(total < 128, total, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(total, 128) / 128)))).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = rank[np.cumsum(new) - 1]
    release()
    return pa.table([table["block"], table["bucket"], pack(out, at)], ["block", "bucket", "keys"])


_NODES = "doc_id bigint, h bigint, h2 int, n bigint, tokens array<bigint>, places array<int>, shingles binary"


def _order_sets(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        own = answers["bucket"].to_numpy() == ROSTER
        sets = Sets(table, roster_from(answers.filter(pa.array(own))["keys"]))
        values, inverse = np.unique(sets.values, return_inverse=True)
        order, _, _ = split_keys(values, buckets)
        rank = np.empty(len(values), np.uint8)
        rank[order] = unpack(answers.filter(pa.array(~own))["keys"], "u1")[0]
        rank = rank[inverse]
        tokens, places, shingles = [], [], []
        for a, b in zip(sets.at[:-1], sets.at[1:]):
            n = b - a
            prefix = n - (PERCENT * n + 99) // 100 + 1 if n else 0
            alone = int((rank[a:b] == 1).sum())
            if alone >= prefix:
                tokens.append([]), places.append([]), shingles.append(None)
                continue
            # Values are sorted, so a stable sort by rank orders by rank, then by value.
            o = np.argsort(rank[a:b], kind="stable")[alone:prefix]
            tokens.append(sets.values[a:b][o].view(np.int64)), places.append(np.arange(alone, prefix, dtype=np.int32))
            shingles.append(sets.values[a:b].tobytes())
        t, sizes = sets.table, np.diff(sets.at)
        return pa.table(
            [t["doc_id"], t["h"], t["h2"], pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(shingles, pa.binary())],
            ["doc_id", "h", "h2", "n", "tokens", "places", "shingles"],
        )

    return run


def ordered_sets(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per distinct text with its set's size and shared prefix, written to the shared folder; and doc_id with its text's key."""
    placed, blocks = blocked(docs, block_bytes)
    buckets = buckets_of(blocks)
    texts = placed.groupBy("block")
    sent = texts.cogroup(firsts(placed, blocks).groupBy("block")).applyInArrow(_send_shingles(buckets), KEYS)
    answers = sent.groupBy("bucket").applyInArrow(_frequencies, "block int, bucket int, keys binary").union(rosters(placed, blocks))
    nodes = texts.cogroup(answers.groupBy("block")).applyInArrow(_order_sets(buckets), _NODES)
    nodes.write.mode("overwrite").parquet(path := shared_path(docs.sparkSession, "sets"))
    return docs.sparkSession.read.parquet(path), placed.select("doc_id", *TEXT_KEY)


def _can_link(a: str, b: str) -> Column:
    """Size filter, and the overlap that is left after the shared shingle's positions."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * left >= PERCENT * (n + m))


def _overlaps(batches):
    for b in batches:
        hits = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if len(x) > len(y):
                x, y = y, x
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[place] == x).sum())
            hits.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(hits, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs u, v whose whole sets reach the similarity. Pairs are written first; a text that is in many of them is a hot key on either side."""
    pairs = settle(pairs, "pairs", 1 + nodes.count() // _NODES_PER_FILE)
    total = pairs.count()
    sets = nodes.filter("shingles is not null").select("doc_id", "shingles")
    x, y = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y"))
    both = join_hot(join_hot(pairs, x, ["u"], "v", total), y, ["v"], "u", total)
    return both.select("u", "v", "x", "y").mapInArrow(bounded(_overlaps), "u bigint, v bigint")


#: Groups of a token that meet all others of it in one task.
_TOGETHER = 512


def _across(entries: DataFrame, span: DataFrame) -> DataFrame:
    """g1, g2 of the groups of different classes that share a token and may link.

    The groups of a token that many hold are dealt over parts, each of which
    meets a copy of all of them, so no task takes more than ``_TOGETHER`` of
    them times the token's groups.
    """
    spanned = entries.join(span, "g").select("g", "n", "token", "place", "low", "high")
    mixed = spanned.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("c")).filter("l < h")
    opened = spanned.join(mixed.select("token", F.ceil(F.col("c") / _TOGETHER).cast("int").alias("parts")), "token")
    a = opened.withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).alias("a")
    b = opened.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    one_class = (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.g") < F.col("b.g")) & ~one_class & _can_link("a", "b")
    return a.join(b, meet).select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2")).distinct()


def classes(nodes: DataFrame) -> DataFrame:
    """node, component of every distinct text that links to another."""
    files = 2 + nodes.count() // _NODES_PER_FILE
    shared = nodes.filter("size(tokens) > 0").select("doc_id", "n", "tokens", "places", F.xxhash64("tokens", "places").alias("prefix"))
    groups = shared.groupBy("n", "prefix").agg(F.min("doc_id").alias("g"))
    members = settle(shared.select("doc_id", "n", "prefix").join(groups, ["n", "prefix"]).select("doc_id", "g"), "members", files)
    heads = shared.join(members.filter("doc_id = g").select("doc_id", "g"), "doc_id")
    entries = heads.select("g", "n", F.get("places", F.lit(0)).alias("alone"), F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("g", "n", "alone", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    entries = settle(entries, "entries", 4 * files)

    best = entries.groupBy("token").agg(F.min(F.struct("alone", "g", "n", "place")).alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", F.col("b.g").alias("g"), F.col("b.n").alias("n"), F.col("b.place").alias("place"))
    best = best.select("token", F.col("g").alias("bg"), F.struct("n", "place").alias("b"))
    first = join_hot(entries.select("token", "g", F.struct("n", "place").alias("a")), best, ["token"], "g", entries.count()).filter((F.col("g") != F.col("bg")) & _can_link("a", "b")).select(F.col("g").alias("u"), F.col("bg").alias("v")).distinct()
    within = members.filter("doc_id != g").select(F.col("doc_id").alias("u"), F.col("g").alias("v"))
    found = components(settle(verified(first.union(within), nodes), "links", 4 * files), files)

    label = F.coalesce("component", "doc_id")
    labelled = settle(members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "g", label.alias("c")), "labelled", files)
    span = labelled.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    same = span.filter("low < high").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    left, right = labelled.select(F.col("g").alias("g1"), F.col("doc_id").alias("u"), F.col("c").alias("cu")), labelled.select(F.col("g").alias("g2"), F.col("doc_id").alias("v"), F.col("c").alias("cv"))
    rest = _across(entries, span).union(same).join(left, "g1").join(right, "g2").filter("cu != cv and (g1 != g2 or u < v)").select("u", "v")
    more = verified(rest, nodes)
    labels = labelled.select("doc_id", "c")
    merged = more.join(labels.select(F.col("doc_id").alias("u"), F.col("c").alias("cu")), "u").join(labels.select(F.col("doc_id").alias("v"), F.col("c").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    joined = components(settle(merged, "merged", files), files).select(F.col("node").alias("c"), "component")
    return labels.join(joined, "c", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "c").alias("component"))


def near_duplicate_classes(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    nodes, keyed = ordered_sets(docs, block_bytes)
    found = classes(nodes).withColumnRenamed("node", "doc_id")
    info = nodes.select("doc_id", *TEXT_KEY, "n").join(found, "doc_id", "left").select(*TEXT_KEY, "n", F.coalesce("component", "doc_id").alias("c"), F.col("doc_id").alias("rep"))
    # Rows that share an id with other text are one document: texts of one key have one representative.
    both = join_hot(keyed, info, TEXT_KEY, "doc_id", docs.count())
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c"))
    return both.withColumn("component", component).select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of texts, that of its smallest id, unchanged.

    Rows that repeat an id and its text are one document, and of them that of the smallest hash of all
    columns stays. Different texts under one id, null included, are documents of their own: their keys
    are 62-bit hashes of the text, which sort before all ids for a null id and after all below 2**62
    for others, so such documents stay only where their class has none with an id of its own.
    An empty table gives an empty one; columns may have any names.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), text.alias("h"), own.alias("row"))
    ids = rows.groupBy("id").agg((F.min("h") != F.max("h")).alias("shared"), (F.count(F.lit(1)) > 1).alias("repeated")).filter("repeated")
    some = ids.agg(F.count_if("shared"), F.count(F.lit(1))).first()
    if some[0]:
        made = F.col("h").bitwiseAND(F.lit((1 << 62) - 1))
        made = F.when(F.col("id") == NULL_ID, made + F.lit(NULL_ID + 1)).otherwise(made + F.lit(1 << 62))
        rows = join_hot(rows, ids.filter("shared").select("id", "shared"), ["id"], "h", docs.count(), "left").withColumn("id", F.when(F.col("shared"), made).otherwise(F.col("id")))
    found = near_duplicate_classes(rows.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("row.text").alias("text")))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id")).distinct()
    rows = rows.join(kept, "id", "left_semi")
    if some[1]:
        rows = rows.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
