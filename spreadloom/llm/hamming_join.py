"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``chunks`` x 4 symbols of 16 bits, the low bits of minima of hashed word shingles; its distance is the
number of differing symbols. Signatures at a distance of at most 2 * chunks - 1 have, by the pigeonhole principle, a
chunk with at most one differing symbol, and so agree on one of the four ways to leave out one symbol of that chunk.
Those ways are the index keys, so a join on them finds every pair within that distance. The number of chunks follows
from the similarity asked for, so that a pair just at it lies farther with a probability of at most ``MISS``. A longer
sketch of one-bit minima is compared before full sets are; it rejects a pair just at the similarity with a probability
of about 1e-7 (``DEVIATIONS``), which adds to ``MISS``.

Equal shingle sets are one class and one node. In each bucket of the index all are first compared with the smallest
node; found links join components. Then, once, members of different components are compared within their buckets, in
blocks, each pair only in the smallest key that its signatures share: by signature, by sketch, and what is left on full
sets, in the task that has both. Out come only links that join components within the task. So a group of thousands of
near copies gives about one row each, nothing is emitted for pairs that aren't links, and no link between components is
missed. Every link is confirmed on full shingle sets, and only nodes that have a possible partner have their full set
moved. The steps are written tables; joins of tables that grow with the documents are shuffled at every size.

Defined results: texts without words, or null, have an empty set and are linked with nothing; rows that share an id
count as one document; a null id takes no part in links, its component is null and it is kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, dropped, partitions, prepare, stored, text_or_empty
from .components import components

MISS = 1e-5
SYMBOLS = 4  # a chunk
#: Rows of a bucket that are compared with as many others in one step.
BLOCK = 1024
#: Bits of the longer sketch, and deviations from the mean distance of pairs just similar enough that it allows.
SKETCH_BITS, DEVIATIONS = 512, 5.2
ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks_for(similarity: float) -> int:
    """Chunks so that a pair of that similarity has one with at most one differing symbol, but for MISS of all pairs."""
    meets = similarity**SYMBOLS + SYMBOLS * similarity ** (SYMBOLS - 1) * (1 - similarity)
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(meets, 1 - 1e-12)))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. bytes.lower and bytes.split know A-Z and x20, x09-x0D only."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()), np.uint64)
    n = min(width, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total = mixed(total * ODD + words[k : len(words) - n + 1 + k])
    return np.unique(total)


def signature(hashes: np.ndarray, chunks: int) -> np.ndarray:
    """The symbols of a set that isn't empty."""
    k = np.arange(1, SYMBOLS * chunks + 1, dtype=np.uint64)
    times, plus = mixed(k * ODD) | np.uint64(1), mixed(k + ODD)
    least = np.full(len(k), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 16384):
        least = np.minimum(least, (hashes[None, at : at + 16384] * times[:, None] + plus[:, None]).min(1))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS further minima of a set that isn't empty, packed. It only estimates, so 32 bits of
    the hashes are enough."""
    k = np.arange(1001, 1001 + SKETCH_BITS, dtype=np.uint64)
    times, plus = (mixed(k * ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mixed(k + ODD) >> np.uint64(32)).astype(np.uint32)
    least, short = np.full(SKETCH_BITS, np.uint32(2**32 - 1)), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, (short[None, at : at + 256] * times[:, None] + plus[:, None]).min(1))
    return np.packbits((mixed(least.astype(np.uint64) + ODD) & np.uint64(1)).astype(bool)).view(np.uint64)


def sketch_reach(percent: int) -> int:
    """Most differing bits of sketches of a pair that is just similar enough."""
    p = (1 - percent / 100) / 2
    return int(SKETCH_BITS * p + DEVIATIONS * np.sqrt(SKETCH_BITS * p * (1 - p)))


def sketches(docs: DataFrame, width: int, chunks: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_id, signature, sketch) of every row; the last three null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                sets = [shingles(text, width) for text in part.column(1).to_pylist()]
                full = [own if len(own) else None for own in sets]
                columns = [
                    part.column(0),
                    pa.array(map(len, sets), pa.int64()),
                    *(pa.array([None if own is None else f(own) for own in full], pa.binary()) for f in (set_name, lambda own: signature(own, chunks).tobytes(), lambda own: sketch(own).tobytes())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_shingles", "set_id", "signature", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, text_or_empty(text_col).alias("text"))
    return own.mapInArrow(work, f"{id_col} {kind}, n_shingles long, set_id binary, signature binary, sketch binary")


def set_name(hashes: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def index_keys(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, node): for each chunk and each symbol left out, the other three symbols and which they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, SYMBOLS).astype(np.int64)
            keys = np.empty((len(sig), chunks, SYMBOLS), np.int64)
            for out in range(SYMBOLS):
                one, two, three = (sig[:, :, k] for k in range(SYMBOLS) if k != out)
                keys[:, :, out] = (np.arange(chunks) * SYMBOLS + out) << 48 | one << 32 | two << 16 | three
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), chunks * SYMBOLS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), node], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(work, "key long, node long")


def within(pairs: DataFrame, chunks: int, percent: int) -> DataFrame:
    """Of rows (a, b, n_a, n_b, signature_a, signature_b, sketch_a, sketch_b): the pairs (a, b) that these leave possible."""
    reach = sketch_reach(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (as_words(batch, f"signature_{x}", np.uint16) for x in "ab")
                c, d = (as_words(batch, f"sketch_{x}", np.uint64) for x in "ab")
                near = ((a != b).sum(1) <= 2 * chunks - 1) & (np.bitwise_count(c ^ d).sum(1) <= reach)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    sized = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.mapInArrow(work, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a partition that is sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), table.num_rows]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            part = table.slice(a, b - a)
            if k or held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                if held:
                    yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def dealt_blocks(members: DataFrame) -> DataFrame:
    """Rows (key, i, j, block, node, label) of every two blocks of a bucket that have to be compared, of members
    (key, node, label, size). A bucket of at most BLOCK rows is one block. A larger one is cut by hash: each label of
    more rows than that for itself, the others together. Blocks of one and the same label are left out. Hot buckets are
    salted, so that no task has a whole one.
    """
    few = members.where(F.col("size") <= BLOCK)
    open_keys = few.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    zero = F.lit(0).cast("long")
    cold = few.join(open_keys, "key", "left_semi").select("key", zero.alias("i"), zero.alias("j"), zero.alias("block"), "node", "label")

    salts = max(16, partitions(members.sparkSession) // 4)
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    many = members.where(F.col("size") > BLOCK).select("key", "node", "label", salt)
    of_label = many.groupBy("key", "label").count()
    large = of_label.where(F.col("count") > BLOCK).select("key", "label", F.ceil(F.col("count") / BLOCK).alias("own_lots"), every_salt)
    rest = of_label.where(F.col("count") <= BLOCK).groupBy("key").agg(F.sum("count").alias("n")).select("key", F.ceil(F.col("n") / BLOCK).alias("lots"), every_salt)
    lot = F.xxhash64("node", F.lit("lot"))
    block = F.when(F.col("own_lots").isNull(), F.pmod(lot, "lots")).otherwise(F.xxhash64("label", F.pmod(lot, "own_lots")))
    placed = many.join(large, ["key", "label", "salt"], "left").join(rest, ["key", "salt"], "left").select("key", "node", "label", block.alias("block"))
    bounds = placed.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left = bounds.select("key", F.col("block").alias("i"), "low", "high")
    right = bounds.select("key", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    steps = left.join(right, "key").where((F.col("i") <= F.col("j")) & ~((F.col("low") == F.col("high_j")) & (F.col("high") == F.col("low_j"))))
    steps = steps.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return cold.unionByName(placed.join(steps, ["key", "block"]).select(*cold.columns))


def as_words(group: pa.Table | pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), kind).reshape(group.num_rows, -1)


def smallest_shared(one: np.ndarray, two: np.ndarray, chunks: int) -> np.ndarray:
    """The top part of the smallest index key that signatures share, row by row; they share one."""
    same = (one == two).reshape(-1, chunks, SYMBOLS)
    first = (same.sum(2) >= SYMBOLS - 1).argmax(1)
    return first * SYMBOLS + same[np.arange(len(same)), first].argmin(1)  # of equal chunks: the first way


def candidates(group: pa.Table, chunks: int, percent: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of two blocks with different labels that sizes, sketches and signatures leave possible, and
    that share no smaller key than this one."""
    label, n, bits, sig = group.column("label").to_numpy(), group.column("n").to_numpy(), as_words(group, "sketch", np.uint64), as_words(group, "signature", np.uint16)
    block, i, j, way = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("key")[0].as_py() >> 48
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    apart = np.zeros((len(one), len(two)), np.uint16)
    for k in range(bits.shape[1]):
        apart += np.bitwise_count(bits[one, k][:, None] ^ bits[two, k][None, :])
    a, b = np.nonzero((apart <= reach) & (label[one][:, None] != label[two][None, :]))
    a, b = one[a], two[b]
    sized = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
    a, b = a[sized], b[sized]
    near = np.zeros(len(a), bool)
    for k in range(0, len(a), 65536):
        x, y = sig[a[k : k + 65536]], sig[b[k : k + 65536]]
        near[k : k + 65536] = ((x != y).sum(1) <= 2 * chunks - 1) & (smallest_shared(x, y, chunks) == way)
    return a[near], b[near]


DEALT = "key long, i long, j long, block long, node long, label long, n long, signature binary, sketch binary"


def worth_comparing(rows: DataFrame, chunks: int, percent: int) -> DataFrame:
    """Of dealt rows with n, signature and sketch: those with a candidate for a partner."""
    reach = sketch_reach(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["key", "i", "j"]):
            keep = np.union1d(*candidates(group, chunks, percent, reach))
            if len(keep):
                yield from group.take(pa.array(keep)).combine_chunks().to_batches()

    dealt = rows.select(*(x.split()[0] for x in DEALT.split(", "))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(work, DEALT)


def links_inside(rows: DataFrame, sets: DataFrame, chunks: int, percent: int) -> DataFrame:
    """Links (a, b) between labels of dealt rows, on full sets; of each two blocks a forest over their labels."""
    reach = sketch_reach(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["key", "i", "j"]):
            node, label = group.column("node").to_numpy(), group.column("label").to_numpy().tolist()
            sets_ = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
            ids = np.split(np.unique(np.concatenate(sets_), return_inverse=True)[1], np.cumsum([len(x) for x in sets_])[:-1])
            has = np.zeros(max(x.max() for x in ids) + 1, bool)
            root = {x: x for x in label}

            def find(x: int, root: dict = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            a, b = candidates(group, chunks, percent, reach)
            cut = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else []
            found = []
            for lo, hi in zip(cut, cut[1:]):
                x = a[lo]
                has[ids[x]] = True
                for y in b[lo:hi].tolist():
                    if find(label[x]) != find(label[y]):
                        both = int(has[ids[y]].sum())
                        if 100 * both >= percent * (len(ids[x]) + len(ids[y]) - both):
                            root[find(label[x])] = find(label[y])
                            found.append((node[x], node[y]))
                has[ids[x]] = False
            if found:
                x, y = map(np.array, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    full = rows.join(sets, "node").select(*rows.columns, "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return full.mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, hashes) are similar enough. The set of ``a`` is held while the sets of
    its partners stream by; a node with many partners is dealt to several tasks.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("fan"))
    salted = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"))
    first = fan.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "hashes")
    rest = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "hashes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, []
        for batch in batches:
            a_, b_ = [], []
            for a, b, hashes in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes"))):
                if a != node:
                    node, own = a, []
                hashes = np.frombuffer(hashes, np.uint64)
                if b is None:
                    own.append(hashes)  # rows that share an id may hold several texts
                    continue
                for x in own:
                    both = len(np.intersect1d(x, hashes, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(hashes) - both):
                        a_.append(a)
                        b_.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    dealt = first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(work, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the given nodes, from their texts. Spark decides by the size of the nodes how they join."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                kept = [k for k, own in enumerate(sets) if len(own)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int32())), pa.array([sets[k].tobytes() for k in kept], pa.binary())], ["node", "hashes"])

    own = docs.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text")).join(nodes, "node", "left_semi")
    return own.mapInArrow(work, "node long, hashes binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of documents whose sets of distinct ``width``-word
    shingles have 100 * intersection >= percent * union; a component is named by its smallest id, which is kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    chunks = chunks_for(percent / 100)
    rows = stored(sketches(docs, width, chunks, id_col, text_col), "sketches")
    first = [F.first(c).alias(c) for c in ("signature", "sketch")]
    own_id = F.col(id_col).cast("long")
    classes = stored(rows.where(F.col("set_id").isNotNull() & own_id.isNotNull()).groupBy("set_id").agg(F.min(own_id).alias("node"), F.first("n_shingles").alias("n"), *first, F.count("*").alias("copies")), "classes")
    nodes = classes.select("node", "n", "signature", "sketch")

    keyed = stored(index_keys(nodes, chunks), "keys")
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    inside = stored(keyed.join(shared.hint("merge"), "key").select("key", "node", "leader", "size"), "buckets")
    dropped(keyed)

    of_a, of_b = (nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "signature", "sketch")]) for x in "ab")
    stars = inside.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tested = stored(within(stars.join(of_b.hint("merge"), "b").join(of_a.hint("merge"), "a"), chunks, percent), "tested")
    of_stars = tested.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(full_sets(docs, of_stars.hint("merge"), width, id_col, text_col), "sets")
    links = stored(confirmed(tested, sets, percent), "links")
    labels = components(links)
    members = inside.where("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "size")
    doubtful = stored(worth_comparing(dealt_blocks(members).join(nodes.hint("merge"), "node"), chunks, percent), "doubtful")
    unseen = stored(doubtful.select("node").distinct().join(sets.select("node"), "node", "left_anti"), "unseen")
    more_sets = stored(full_sets(docs, unseen, width, id_col, text_col), "sets") if unseen.limit(1).count() else sets.limit(0)
    more = stored(links_inside(doubtful, sets.union(more_sets), chunks, percent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    for gone in (inside, sets, tested, doubtful, unseen, more_sets):
        dropped(gone)

    # A class needs a row of its own here only if it has copies or links; hot classes are dealt out by salt.
    salts = max(8, partitions(spark) // 4)
    special = classes.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").select("set_id", F.coalesce("label", "node").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own = rows.select(id_col, "n_shingles", "set_id", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"))
    component: Column = F.when(F.col(id_col).isNull(), None).otherwise(F.coalesce("component", F.col(id_col)))
    return (
        own.join(special, ["set_id", "salt"], "left")
        .select(id_col, "n_shingles", component.cast("long").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )
