"""N-gram Jaccard self-join by filtering under several global token orders.

A text is its set of distinct word shingles. Under any one order of all shingles, two sets with
the wanted similarity share a shingle among the first few of both (the prefix). Three orders are
used. All put rare shingles first, by a count sketch over all texts, and differ in how they order
shingles of about the same frequency. The first order's prefixes are the postings that bring
texts together; a candidate must also share prefix shingles under the second and the third order
before its sets are compared in full.

The result is connected components, so groups of near copies need not be paired out. First each
posting list tests its members against one of them, its pivot (the member whose shared shingle
stands earliest). After these links are joined up, only members of different components remain
to be paired; the position of the shared shingle with the sizes (which bound the overlap) and odd
sketches of the sets (which bound the difference) decide whether a pair can still be similar, before
it becomes a row. No list is cut off: a member leaves a list only where these bounds exclude every
other member of it. A pair's sketches as long as its sets are looked at before its prefixes, and its
prefixes before its sets, so that few pairs of unlike sets move whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import components, fresh, joined_small, left_join_groups, small_batches, staged
from colonnade.llm.tokens import slices

#: Size of the count sketch: its numbers are all that the driver sees.
SKETCH_BITS = 19
#: Bytes of texts that are cut into shingles together; hashing holds some 40 bytes for each.
SLICE = 1 << 20
#: Row keys of texts to compare are broadcast up to this many (counted first), shuffled beyond.
BROADCAST_ROWS = 200_000
#: Ratio between the size classes in which remaining pairs are looked up.
SIZE_RATIO = 1.01
#: Posting lists up to this long are paired without size classes.
SHORT_LIST = 64
ODD = ("odd1", "odd2", "odd3", "odd4")

_random = np.random.default_rng(20_240_607)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
BYTE_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES[BLANK] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors: of a shingle's words by place, and of the three orders.
PLACES = _random.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
ORDERS = (_random.integers(1, 1 << 63, 3, np.uint64) | np.uint64(1)).tolist()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles of all texts in a row, and where each text's begin.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = ~blank[edges]
    begin = np.flatnonzero(starts)
    if len(begin):
        at = np.arange(len(data)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(data)]))
        powers = np.full(int(at.max()) + 1, BASE)
        powers[0] = 1
        word = np.add.reduceat(BYTE_VALUES[data] * np.multiply.accumulate(powers)[at], begin)
        word = mixed(word)
    else:
        word = np.empty(0, np.uint64)
    first = np.searchsorted(begin, offsets)
    counts = np.diff(first)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_at = np.r_[0, np.cumsum(sizes)]
    text_of = np.repeat(np.arange(len(counts)), sizes)
    source = first[:-1][text_of] + np.arange(len(text_of)) - out_at[:-1][text_of]
    total = np.zeros(len(text_of), np.uint64)
    for k in range(words):
        there = source + k < first[1:][text_of]  # false only in texts shorter than a shingle
        total[there] += word[source[there] + k] * PLACES[k]
    return mixed(total + np.minimum(counts, words)[text_of].astype(np.uint64)), out_at


def set_name(tokens: np.ndarray) -> int:
    """64-bit name of a set of shingle hashes, as long as those hashes themselves."""
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


def parity(own: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketch of a set: of each of `bits` (a power of two) the parity of the shingles that fall to it."""
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """How many first tokens of a set of n must hold one that a similar set has among its own."""
    return n - -(-percent * n // 100) + 1


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Class of each sketch bucket (quarter powers of two of its count over all texts)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for some in slices(batch, 0, size=SLICE):
                total += np.bincount(_bucket(shingles(some.column(0), words)[0]), minlength=len(total))
        there = np.flatnonzero(total)
        for at in range(0, len(there), 1 << 16):
            own = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["bucket", "n"])

    counts = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << SKETCH_BITS)
    total[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return np.floor(4 * np.log2(total + 1)).astype(np.uint8)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Per row: id, `row` (hash of id and text), `n`, `set` (name of its shingles, null if it
    has none), the prefixes under the three orders and `parity`, an odd sketch of at least as many bits
    as the set has shingles, given once per set and task, and an odd sketch of 256 bits."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, text_col, words))
    schema = T.StructType([docs.schema[id_col], T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.LongType()), *(T.StructField(f"p{k}", T.ArrayType(T.LongType() if k == 1 else T.IntegerType(), False)) for k in (1, 2, 3)), T.StructField("parity", T.ArrayType(T.LongType(), False)), *(T.StructField(o, T.LongType()) for o in ODD)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = classes.value.astype(np.uint64) << np.uint64(56), set()
        for batch in batches:
            for some in slices(batch, 2, size=SLICE):
                tokens, at = shingles(some.column(2), words)
                sizes, names, odd, parities = [], [], [], []
                prefixes: tuple[list, list, list] = ([], [], [])
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.unique(tokens[a:b])
                    sizes.append(len(own))
                    name = set_name(own) if len(own) else None
                    names.append(name)
                    odd.append(parity(own, 64 * len(ODD)))
                    if name is None or name in seen:
                        for p in (*prefixes, parities):
                            p.append(None)
                        continue
                    seen.add(name)
                    parities.append(parity(own, max(64 * len(ODD), 1 << (len(own) - 1).bit_length())))
                    length, first = prefix_length(len(own), percent), rank[_bucket(own)]
                    for k, factor in enumerate(ORDERS):
                        key = first | (mixed(own * np.uint64(factor)) >> np.uint64(8))
                        chosen = own[np.argsort(key, kind="stable")[:length]]
                        prefixes[k].append(chosen.view(np.int64) if k == 0 else (chosen >> np.uint64(32)).astype(np.uint32).view(np.int32))
                arrays = [pa.array(p, schema_type) for p, schema_type in zip(prefixes, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())))]
                odds = np.array(odd, np.int64).reshape(-1, len(ODD)).T
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *arrays, pa.array(parities, pa.list_(pa.int64())), *(pa.array(x) for x in odds)], names=schema.names)

    rows = docs.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col))
    return rows.mapInArrow(describe, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """`set` and all its `tokens` for the rows in `wanted` (`row`, one per set), once per set and
    task: rows that repeat id and text come at most as often as there are tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in slices(batch, 1, size=SLICE):
                tokens, at = shingles(some.column(1), words)
                found = {}
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.unique(tokens[a:b])
                    found.setdefault(set_name(own), own)
                found = {k: v for k, v in found.items() if k not in seen}
                seen.update(found)
                own, names = found.values(), pa.array(found, pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["set", "tokens"])

    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    found = joined_small(rows, wanted.select("row"), ["row"], "left_semi", BROADCAST_ROWS)
    with small_batches(docs.sparkSession):
        return staged(found.select("row", "text").mapInArrow(whole, "set long, tokens array<long>"), "full_sets")


def _differing(left: str, right: str) -> Column:
    """Bits in which two `parity` sketches differ, the longer one folded to the length of the other."""
    length = F.least(F.size(left), F.size(right))
    folded = lambda x, i: F.aggregate(F.sequence(i, F.size(x) - 1, length), F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.get(x, k)))
    return F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda n, i: n + F.bit_count(folded(left, i).bitwiseXOR(folded(right, i))))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that share prefixes under all orders and are similar enough."""
    pairs = staged(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sides = lambda p, a, b: p.select(F.col(a).alias("set")).union(p.select(F.col(b).alias("set"))).distinct()
    known = staged(joined_small(sets.where("p2 is not null").select("set", "row", "n", "p2", "p3", "parity"), sides(pairs, "a", "b"), ["set"], "left_semi", BROADCAST_ROWS).dropDuplicates(["set"]), "prefixes")
    side = lambda df, name: df.select(*[F.col(c).alias(name if c == "set" else f"{c}_{name}") for c in df.columns])
    both = lambda p, df: p.join(side(df, "a"), "a").join(side(df, "b"), "b")
    few = (100 + percent) * _differing("parity_a", "parity_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))  # as in _odd_bits_allow
    close = staged(both(pairs, known.select("set", "n", "parity")).where(few).select("a", "b"), "close")
    prefixed = joined_small(known.select("set", "row", "p2", "p3"), sides(close, "a", "b"), ["set"], "left_semi", BROADCAST_ROWS)
    likely = staged(both(close, prefixed).where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b", "row_a", "row_b"), "likely")
    wanted = likely.select(F.col("row_a").alias("row")).union(likely.select(F.col("row_b").alias("row"))).distinct()
    full = _full_sets(docs, staged(wanted, "wanted"), id_col, text_col, words)
    compared = both(likely.select("a", "b"), full)
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return compared.where(100 * shared >= percent * (F.size("tokens_a") + F.size("tokens_b") - shared)).select("a", "b").distinct()


def _may_be_similar(left: str, right: str, percent: int):
    """Can two sets with a common token at these places of the first order reach the similarity?
    What stands before the first common token is not shared, so it bounds the overlap."""
    rest = F.least(F.col(f"{left}.n") - F.col(f"{left}.pos"), F.col(f"{right}.n") - F.col(f"{right}.pos"))
    return (100 + percent) * rest >= percent * (F.col(f"{left}.n") + F.col(f"{right}.n"))


def _odd_bits_allow(left: str, right: str, percent: int):
    """Bits in which two odd sketches differ are at most the shingles that only one set has."""
    differing = sum((F.bit_count(F.col(f"{left}.{o}").bitwiseXOR(F.col(f"{right}.{o}"))) for o in ODD), F.lit(0))
    return (100 + percent) * differing <= (100 - percent) * (F.col(f"{left}.n") + F.col(f"{right}.n"))


def _list_members(postings: DataFrame, percent: int) -> DataFrame:
    """`postings` (set, n, pos, token) that may have a similar set in their list, with the list's `pivot`.

    By `_may_be_similar` a set's partner in a list has at most `most` shingles. So members leave whose
    `most` is below the smallest size of the list, or whose size is above the largest `most`; lists
    that hold one set alone, or two that exclude each other, leave as a whole. Lists are summed up
    and joined with their members where one shuffle has put them.
    """
    # nothing here is null; said before the shuffle, so that no filter is put in front of it on one side only
    postings = postings.where("token is not null and n is not null and pos is not null").repartition("token")
    most = F.floor(((100 + percent) * (F.col("n") - F.col("pos")) - percent * F.col("n")) / percent)
    member = F.struct("pos", "n", "set")
    lists = postings.groupBy("token").agg(F.min(member).alias("pivot"), F.max(member).alias("last"), F.min("n").alias("least"), F.max(most).alias("reach"), F.count(F.lit(1)).alias("length"))
    lists = lists.where((F.col("pivot") != F.col("last")) & ((F.col("length") > 2) | _may_be_similar("pivot", "last", percent)))
    lists = lists.select("token", "pivot", "least", "reach")
    return postings.join(lists, "token").where((most >= F.col("least")) & (F.col("n") <= F.col("reach"))).drop("least", "reach")


def _undecided_lists(labelled: DataFrame, percent: int) -> DataFrame:
    """`token`, `length` of lists whose members lie in several components. Of lists of two the
    sizes, the place and the sketches (the bits in which they differ are the sums') already tell."""
    lists = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("length"), F.sum("n").alias("n"), F.min(F.col("n") - F.col("pos")).alias("rest"), *[F.bit_xor(o).alias(o) for o in ODD])
    differing = sum((F.bit_count(o) for o in ODD), F.lit(0))
    possible = ((100 + percent) * F.col("rest") >= percent * F.col("n")) & ((100 + percent) * differing <= (100 - percent) * F.col("n"))
    return lists.where((F.col("lo") < F.col("hi")) & ((F.col("length") > 2) | possible)).select("token", "length")


def similar_sets(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """`node`, `component` of all sets that are linked to another one."""
    postings = sets.where("p1 is not null").select("set", "n", F.posexplode("p1").alias("pos", "token"))
    members = staged(_list_members(postings, percent), "members")
    mine = members.select("token", F.struct("pos", "n", "set").alias("x"), "pivot")
    to_pivot = mine.where((F.col("x.set") != F.col("pivot.set")) & _may_be_similar("x", "pivot", percent))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = staged(_verified(to_pivot.select(*ordered("x.set", "pivot.set")).distinct(), sets, docs, id_col, text_col, words, percent), "links")
    so_far = components(links)
    described = sets.where("p1 is not null").select("set", *ODD).dropDuplicates(["set"]).join(so_far.withColumnRenamed("node", "set"), "set", "left")
    labelled = members.drop("pivot").join(described.withColumn("component", F.coalesce("component", "set")), "set")
    left = staged(labelled.join(_undecided_lists(labelled, percent), "token"), "left")
    size_class = lambda n: F.when(F.col("length") > SHORT_LIST, F.floor(F.log(n) / F.log(F.lit(SIZE_RATIO)))).otherwise(0)
    # the larger set looks for the smaller ones that its own place of the token still allows
    highest = F.floor(((100 + percent) * (F.col("n") - F.col("pos")) - percent * F.col("n")) / percent)
    largest, smallest = F.least(highest, F.col("n")), F.ceil(percent * F.col("n") / 100)
    seeking = left.where(largest >= smallest).withColumn("class", F.explode(F.sequence(size_class(smallest), size_class(largest))))
    seeking = seeking.select("token", "class", F.struct("pos", "n", "set", *ODD).alias("x"), F.col("component").alias("cx"))
    offered = left.select("token", size_class(F.col("n")).alias("class"), F.struct("pos", "n", "set", *ODD).alias("y"), F.col("component").alias("cy"))
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.set") > F.col("y.set")))
    possible = larger & _may_be_similar("x", "y", percent) & _odd_bits_allow("x", "y", percent)
    apart = seeking.join(offered, ["token", "class"]).where((F.col("cx") != F.col("cy")) & possible)
    tried = to_pivot.select(*ordered("x.set", "pivot.set")).distinct()
    rest = apart.select(*ordered("x.set", "y.set")).distinct().join(tried, ["a", "b"], "left_anti")
    more = staged(_verified(rest, sets, docs, id_col, text_col, words, percent), "more_links")
    if more.isEmpty():
        return so_far
    return components(links.union(more))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of `docs`: id, `row`, `n_shingles`, `component_id`, `stays`.

    A link is a Jaccard similarity of at least `percent` / 100 between the sets of distinct word
    shingles (words between ASCII blanks, A-Z lower-cased). `component_id` is the smallest id
    reachable by links, itself included; null ids are passed over unless there are no others.
    Texts that are null, empty or blank have no shingles and no links. Of each component one row
    has `stays` (rows that repeat id and text all have it). Only id and text are read; an empty
    table gives no rows.
    """
    with small_batches(docs.sparkSession):
        sets = staged(_sets(docs, id_col, text_col, words, percent), "sets")
    labels = similar_sets(docs, sets, id_col, text_col, words, percent)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row")).alias("best")
    classes = sets.where("set is not null").groupBy("set").agg(best, F.count(F.lit(1)).alias("size"))
    named = classes.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    named = staged(named, "classes")
    firsts = named.groupBy("component").agg(F.min("best").alias("best"), F.sum("size").alias("members"))
    firsts = firsts.where("members > 1")
    total = named.agg(F.sum("size")).first()[0] or 0
    grouped = left_join_groups(named.select("set", "size", "component"), firsts, "component", "members", total).where("best is not null").select("set", "size", "best")
    rows = left_join_groups(sets.select(id_col, "row", "n", "set"), grouped, "set", "size", total)
    return rows.select(
        id_col, "row", F.col("n").alias("n_shingles"),
        F.when(F.col("best").isNull(), F.col(id_col)).otherwise(F.col("best.id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("stays"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with all their columns; of rows that
    repeat id and text one stays if they have shingles, else all (they are linked with nothing)."""
    row = fresh(docs, "_row")
    groups = near_groups(docs, id_col, text_col, words, percent)
    dropped = groups.where("not stays").select(F.col("row").alias(row))
    gone = staged(dropped.distinct(), "near_copies")
    left = joined_small(docs.withColumn(row, F.xxhash64(id_col, text_col)), gone, [row], "left_anti", BROADCAST_ROWS)
    # rows that repeat id and text: few or none once exact copies are gone
    counted = groups.where("stays and n_shingles > 0").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(counted.select(F.col("row").alias(row)), "repeated")
    once = joined_small(left, repeated, [row], "left_semi", BROADCAST_ROWS).dropDuplicates([row])
    return joined_small(left, repeated, [row], "left_anti", BROADCAST_ROWS).unionByName(once).drop(row)
