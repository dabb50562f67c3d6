"""N-gram Jaccard join by several global token orders.

Documents are sets of word shingles. Two sets with Jaccard similarity t or more share a token among the
first n - ceil(t n) + 1 tokens of each, under any total order of all tokens. Three orders are used here:

1. Rare first: by how many documents hold a token. It is built in two steps. First a quarter of all tokens
   (by hash) is counted over the whole corpus and put in front; it is larger than the prefix in all but short
   documents, which send what they need beyond. Tokens that no other document has match nothing, and a
   document whose prefix is made of these alone has no partner and leaves. For those that stay all tokens
   are counted, among each other, so that the order is by rarity throughout. A token at position i of a
   document, if it is the first that two share, leaves n - i for the overlap: this bounds the sizes of
   partners, and places whose list holds no document of such a size are dropped before lists are joined.
2. By hash, upwards. 3. By hash, downwards.

Documents that share a prefix token under order 1 are candidates. They must share prefix tokens under orders 2
and 3 as well, which is looked up in narrow rows: the two prefixes in 32 bits a token, and the parities of the
tokens per hash bucket. Two sets differ in at least as many tokens as in parities, so pairs with too many of
these (pages of one template that differ here and there, for instance) are refused before any whole set moves.

Groups of copies are not expanded into pairs. Equal sets are one node. Candidates are found in two rounds:
first each node is compared with one node (the lead of most of its posting lists), which joins most groups
as stars; then all pairs of a posting list that are still in different
components. No pair that could join two components is left out, so components are exact.

Defined results: null and empty texts have no shingles and are linked with nothing; a text of fewer words
than a shingle is one shingle; equal rows are linked with each other; a null id is the component's id only
where no member has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import PLAIN_WORD, packed, unpacked, written
from fleetlens.llm.components import components

WIDTH = 5
PERCENT = 80
#: One token in so many is counted and comes first in order 1; the prefix holds one in five.
COUNTED = 4
#: Ids of documents to compare are sent to all tasks up to this many (some 30 MB); beyond, texts are shuffled.
BROADCAST_ROWS = 1_000_000
CACHED_WORDS = 300_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, ascending."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < WIDTH:
        value = (each * _MULTIPLIERS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))
    else:
        n = len(words) - WIDTH + 1
        value = each[:n] * _MULTIPLIERS[0]
        for i in range(1, WIDTH):
            value += each[i : i + n] * _MULTIPLIERS[i]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    return np.unique(value)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    pair = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), dtype=np.int64)
    return int(pair[0]), int(pair[1])


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, t, n, counted (tokens of the counted class), d1, d2 (digest of the set), tokens (those of the prefix or counted).

    Of equal sets in one task only the first carries its tokens.
    """
    hashes, met = WordHashes(), set()
    for batch in batches:
        n, counted, first, second, sent = [], [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            tokens = shingles(text, hashes)
            d = _digest(tokens)
            in_class = tokens % np.uint64(COUNTED) == 0
            few = int(in_class.sum())
            n.append(len(tokens))
            counted.append(few)
            first.append(d[0])
            second.append(d[1])
            if not len(tokens) or d in met:
                sent.append(tokens[:0])
                continue
            met.add(d)
            beyond = max(0, prefix_length(len(tokens)) - few)
            sent.append(np.concatenate([tokens[in_class], tokens[~in_class][:beyond]]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "k", "t")), pa.array(n, pa.int64()), pa.array(counted, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _lists(sent)],
            ["doc_id", "k", "t", "n", "counted", "d1", "d2", "tokens"],
        )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, tokens (by hash) of the documents whose set is the node's."""
    hashes, met = WordHashes(), set()
    for batch in batches:
        keep, arrays = [], []
        columns = [batch.column(c).to_pylist() for c in ("node", "d1", "d2")]
        for i, (text, node, d1, d2) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), *columns, strict=True)):
            if node in met:
                continue
            tokens = shingles(text, hashes)
            if _digest(tokens) == (d1, d2):
                met.add(node)
                keep.append(i)
                arrays.append(tokens)
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("node"), some.column("n"), _lists(arrays)], ["node", "n", "tokens"])


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls into each of 2n or more buckets, as 64 of them a number.

    The upper half xor the lower half are the parities of half as many buckets.
    """
    buckets = max(64, 1 << (2 * max(len(tokens), 1) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, up and down (prefixes by hash from either end), odd (parities)."""
    for batch in batches:
        up, down, odd = [], [], []
        for tokens in batch.column("tokens"):
            tokens = np.asarray(tokens.values).view(np.uint64)
            size = prefix_length(len(tokens))
            signed = np.sort(tokens.view(np.int64))
            up.append(signed[:size].astype(np.int32))
            down.append(signed[-size:].astype(np.int32))
            odd.append(parities(tokens))
        short = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, some)], dtype=np.int32), np.concatenate(some) if some else np.empty(0, np.int32)) for some in (up, down)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), *short, _lists(odd)], ["node", "n", "up", "down", "odd"])


def _prefix(n: str) -> F.Column:
    return F.col(n) - F.floor((F.col(n) * PERCENT + 99) / 100) + 1


def _near_sizes(a: str, b: str) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _viable(postings: DataFrame) -> DataFrame:
    """Places of tokens that can be the first one shared with some document of their list."""
    lists = postings.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    fits = (F.col("n") - F.col("pos")) * (100 + PERCENT) >= (F.col("n") + F.col("least")) * PERCENT
    return postings.join(lists, "token").where(fits).drop("least", "k")


def candidates(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under orders 2 and 3 and may differ in few enough tokens."""
    narrow = whole.mapInArrow(_narrow, "node long, n long, up array<int>, down array<int>, odd array<long>")
    a, b = (narrow.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "up", "down", "odd")]) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").where(_near_sizes("n_a", "n_b"))
    both = both.where(F.arrays_overlap("up_a", "up_b") & F.arrays_overlap("down_a", "down_b"))
    size = F.least(F.size("odd_a"), F.size("odd_b"))

    def folded(odd: str) -> F.Column:
        halves = F.zip_with(F.slice(odd, F.lit(1), size), F.slice(odd, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(odd) > size, halves).otherwise(F.col(odd))

    # sizes differ by a quarter at most, so one of them is folded once at most
    counts = F.zip_with(folded("odd_a"), folded("odd_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    differ = F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)
    return both.where(differ * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)).select("a", "b")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a, b = (whole.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a")
    both = both.withColumns({"pa": _prefix("na").cast("int"), "pb": _prefix("nb").cast("int")})
    up = F.arrays_overlap(F.slice("ta", F.lit(1), F.col("pa")), F.slice("tb", F.lit(1), F.col("pb")))
    down = F.arrays_overlap(F.slice("ta", -F.col("pa"), F.col("pa")), F.slice("tb", -F.col("pb"), F.col("pb")))
    both = both.where(_near_sizes("na", "nb") & up & down).withColumn("common", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * PERCENT).select("a", "b")


def linked(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (one row of each component), and the row's key: k and t.

    k is a hash of id and text, t one of the text.
    """
    sets = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("t"), "text").mapInArrow(
        _token_sets, "doc_id long, k long, t long, n long, counted long, d1 long, d2 long, tokens array<long>"
    )
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    nodes = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))

    # order 1: how many documents hold each token; what only one holds is of no use
    tokens = sets.select("row", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    in_class = F.pmod(F.col("token"), F.lit(COUNTED)) == 0
    shared = tokens.join(held, "token").select("row", "token", in_class.alias("in_class"), F.when(in_class, F.col("held")).otherwise(0).alias("held"))
    shared = shared.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("in_class"), F.struct("held", "token")))).alias("first"),
        F.collect_list(F.when(~F.col("in_class"), F.col("token"))).alias("rest"),
    )
    shared = shared.join(sets.select("row", "doc_id", "n", "counted", "d1", "d2"), "row").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    room = F.greatest(F.lit(0), _prefix("n") - (F.col("counted") - F.size("first"))).cast("int")
    shared = shared.withColumn("prefix", F.concat(F.transform(F.slice("first", F.lit(1), room), lambda x: x["token"]), F.col("rest")))
    shared = shared.where(F.size("prefix") > 0).select("node", "doc_id", "row", "d1", "d2", "n")
    # tasks that met the same set each sent it; one of them speaks for it
    speakers = shared.groupBy("node").agg(F.min("row").alias("row"))
    stay = written(shared.join(speakers, ["node", "row"], "left_semi").select("node", "n", F.col("doc_id").alias("_id"), "d1", "d2"), "jaccard-stay")
    few = stay.count() <= BROADCAST_ROWS
    found = documents.select("doc_id", "text").join(F.broadcast(stay) if few else stay, F.col("doc_id").eqNullSafe(F.col("_id")))
    whole = found.select("node", "n", "d1", "d2", "text").mapInArrow(_whole_sets, "node long, n long, tokens array<long>")
    # a row of the same id and text in another task gives the same set again
    whole = written(whole, "jaccard-whole")
    if whole.count() > whole.select("node").distinct().count():
        whole = written(whole.dropDuplicates(["node"]), "jaccard-whole")

    # order 1 among those that stay, by all their tokens
    tokens = whole.select("node", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    prefixes = tokens.join(held, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    prefixes = prefixes.join(whole.select("node", "n"), "node").withColumn("alone", F.col("n") - F.size("shared"))
    room = F.greatest(F.lit(0), _prefix("n") - F.col("alone")).cast("int")
    postings = prefixes.select("node", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), room)).alias("pos", "x"))
    postings = postings.select("node", "n", "alone", (F.col("alone") + F.col("pos")).alias("pos"), F.col("x.token").alias("token"))
    postings = written(_viable(_viable(postings)), "jaccard-postings")

    # the lead of a list is the member with the fewest tokens of its own: copies lie around such a one
    lists = postings.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("lead"))
    first = postings.join(lists, "token").select("node", "n", F.col("lead.node").alias("a"), F.col("lead.n").alias("na"))
    first = first.where("node <> a").where(_near_sizes("n", "na"))
    first = first.groupBy("node", "a").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", -F.col("a"))).alias("best"))
    first = written(first.select((-F.col("best.col2")).alias("a"), F.col("node").alias("b")), "jaccard-pairs")
    stars = written(_verified(first, whole), "jaccard-links")
    joined = components(stars, "a", "b", "jaccard-components")

    # all pairs of a list that are not yet in one component
    part = postings.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = part.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    part = part.join(mixed, "token", "left_semi")
    a, b = (part.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "pos", "component")]) for side in "ab")
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = a.join(b, "token").where("node_a < node_b and component_a <> component_b").where(_near_sizes("n_a", "n_b"))
    pairs = pairs.where(left * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = written(_verified(written(candidates(pairs, whole), "jaccard-candidates"), whole), "jaccard-links")
    if not more.isEmpty():
        joined = components(stars.unionByName(more), "a", "b", "jaccard-components")

    sizes = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = sizes.groupBy("component").agg(F.min("least").alias("component_id"))
    sizes = sizes.join(ids, "component").select("d1", "d2", "component", "component_id")
    rows = sets.where("n > 0").select("doc_id", "k", "t", "n", "d1", "d2", "row").join(sizes, ["d1", "d2"])
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("stays"))
    rows = rows.join(stays, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("stays")).alias("kept"), "k", "t")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "k", "t")
    return rows.unionByName(alone)


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id, one row of it; texts without words stay."""
    stays = linked(documents).where("kept and n_shingles > 0").select(F.col("k").alias("_k"), F.col("t").alias("_t"))
    worded = F.coalesce(F.col("text").rlike(PLAIN_WORD), F.lit(False))
    keyed = packed(documents.where(worded), _k=F.xxhash64("doc_id", "text"), _t=F.xxhash64("text"))
    one = keyed.dropDuplicates(["_k", "_t"]).join(stays, ["_k", "_t"], "left_semi")
    return unpacked(one, documents.columns).unionByName(documents.where(~worded))
