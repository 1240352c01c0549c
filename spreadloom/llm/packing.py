"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents of equal length are interchangeable, so the problem is the table of lengths and their counts: at most
``capacity`` rows, however many documents there are. A packing is a table of bin patterns (the lengths in a bin) and
how often each is used. The genetic algorithm works on such tables: crossover injects whole well-filled bins of one
parent into the other, takes out the other's bins that hold the same documents again, and places what these displace
by best fit. It runs as islands, one Spark group each, whose best packings move to the next island after every epoch.
Then each piece's rank among the pieces of its length gives its bin and place; ranks come from counts of small blocks,
so no length, however frequent, is handled by one task.

Defined results: a null text is empty and gives the end token alone; only documents longer than the capacity are cut;
repeated rows are packed each; an empty table gives no rows; columns beside the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import pickle
import random
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, slices, stored, text_or_empty
from .pretokens import WHITE, printable_bytes

#: Pre-tokens in a worker's memo of ids; a full one begins anew, which changes no result.
MEMO = 500_000
#: Fixed value: what every special string holds; only pieces with it go through the whole library.
MARK = "<|"
#: The pre-token pattern of the word BPE file, with white space by the Unicode property White_Space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

MOST_PATTERNS = 4
ISLANDS, POPULATION, EPOCHS, GENERATIONS, ELITES = 6, 6, 3, 6, 2


def gathered(source: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts of ``source`` that begin there and are so long, one after the other."""
    ends = np.cumsum(lengths)
    return source[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Ids by the tokenizers library for a file that normalizes to NFC and lower case and whose pre-tokenizer drops
    white space. Texts are cut at ASCII white space; the different pieces are cut at the pre-token pattern all at once,
    and the library's BPE model gives the ids of each different pre-token once. Pieces that may hold special strings go
    through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_word_file(json.load(f), path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in printable_bytes().items()}
        self.pattern = regex.compile(WORD_PATTERN.replace(r"\s", "".join(WHITE)) + "|\n")
        self.forget()

    def forget(self) -> None:
        """The memo of pre-tokens: their numbers, and the begins and lengths of their ids. Number 0 ends a piece."""
        self.number, self.begins, self.lengths, self.flat = {"\n": 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def word(self, word: str) -> list[int]:
        if MARK in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        text = word if word.isascii() and word.isprintable() else "".join(map(self.stand_in.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(text)]

    def learn(self, words: set[str]) -> None:
        new = [*words.difference(self.number)]
        if len(self.number) + len(new) > MEMO:
            self.forget()
            new = [*words.difference(self.number)]
        if new:
            ids = [*map(self.word, new)]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and the begin and length of each one's."""
        marked = [MARK in p for p in pieces]
        plain = "\n".join(p for p, m in zip(pieces, marked) if not m)
        if not plain.isascii():
            plain = unicodedata.normalize("NFC", plain).replace("\u03a3", "\u03c3")  # the library lowers each character alone
        found = self.pattern.findall(plain.lower())
        if not all(marked):
            found.append("\n")
        for piece in (p for p, m in zip(pieces, marked) if m):
            found += piece, "\n"
        self.learn({*found})
        at = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        ids, ends = gathered(self.flat, self.begins[at], self.lengths[at]), np.cumsum(self.lengths[at])[at == 0]
        order = np.argsort(np.argsort(marked, kind="stable"), kind="stable")
        begins = np.concatenate([[0], ends[:-1]])
        return ids, begins[order], (ends - begins)[order]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; the last place is where all end."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(split) + 1, np.int64)
        ids, begins, lengths = self.of_pieces(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(lengths[at])])
        return gathered(ids, begins[at], lengths[at]), before[split.offsets.to_numpy()]


def check_word_file(spec: dict, path: str) -> None:
    """Raises for a file whose normalizer, pre-tokenizer or special strings are not those that WordIds is written for."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = cuts[0].get("pattern", {}).get("Regex")
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or pattern != WORD_PATTERN:
        raise ValueError(f"{path}: not a lower-case word BPE file with the expected pre-token pattern")
    if any(MARK not in t["content"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: special strings need {MARK!r} and no white space")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document, cut only where it is longer than the capacity."""
    prepare(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in batches:
            for part in slices(batch, 1):
                of, place, length, crc = [], [], [], []
                flat, begins = coder.encode_all(part.column(1))
                flat, begins = flat.astype("<u4").tobytes(), (4 * begins).tolist()
                for row, (a, b) in enumerate(zip(begins, begins[1:])):
                    ids = flat[a:b] + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        of.append(row)
                        place.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int32())), pa.array(place, pa.int32()), pa.array([k * capacity for k in place], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(work, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins by pattern (lengths, longest first) with multiplicity, and an index of patterns by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free, self.open = capacity, {}, {}, 0

    def add(self, pattern: tuple[int, ...], n: int) -> None:
        if pattern not in self.bins:
            self.bins[pattern] = 0
            free = self.capacity - sum(pattern)
            self.free.setdefault(free, {})[pattern] = None
            self.open |= 1 << free
        self.bins[pattern] += n

    def take(self, pattern: tuple[int, ...], n: int) -> None:
        self.bins[pattern] -= n
        if not self.bins[pattern]:
            del self.bins[pattern]
            free = self.capacity - sum(pattern)
            del self.free[free][pattern]
            if not self.free[free]:
                self.open &= ~(1 << free)

    def place(self, size: int, n: int) -> None:
        """Puts n pieces of a length where they fit best, all bins of a pattern at once."""
        while n:
            fitting = self.open >> size
            if not fitting:
                break
            free = size + (fitting & -fitting).bit_length() - 1
            pattern = next(iter(self.free[free]))
            bins = self.bins[pattern]
            each = min(free // size, max(1, n // bins))
            bins = min(bins, n // each)
            self.take(pattern, bins)
            self.add(tuple(sorted((*pattern, *[size] * each), reverse=True)), bins)
            n -= each * bins
        each = self.capacity // size
        if n >= each:
            self.add((size,) * each, n // each)
        if n % each:
            self.add((size,) * (n % each), 1)

    def n_bins(self) -> int:
        return sum(self.bins.values())

    def fitness(self) -> float:
        """Mean squared fill of the bins: of two packings with as many bins, better has fuller bins."""
        return sum(n * (sum(p) / self.capacity) ** 2 for p, n in self.bins.items()) / max(1, self.n_bins())


def packed(sizes: list[tuple[int, int]], capacity: int) -> Packing:
    out = Packing(capacity)
    for size, n in sizes:
        out.place(size, n)
    return out


def shuffled(counts: dict[int, int], rng: random.Random, noise: float) -> list[tuple[int, int]]:
    """Lengths in nearly falling order; with much noise also in lots, so that lengths mix in a bin."""
    lots = []
    for size, n in counts.items():
        while n:
            lot = rng.randint(1, n) if noise >= 0.3 else n
            lots.append((size, lot))
            n -= lot
    return sorted(lots, key=lambda x: -x[0] * (1 + noise * rng.uniform(-1, 1)))


def crossover(one: dict, other: dict, counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Injects well-filled bins of the other parent, takes out bins that repeat their pieces, best-fits the displaced."""
    child, left = Packing(capacity), dict(counts)
    full = sorted(other.items(), key=lambda x: -sum(x[0]))
    for pattern, n in full[: max(1, len(full) // 2)]:
        if rng.random() < 0.5:
            child.add(pattern, n)
            for size in pattern:
                left[size] -= n
    for pattern, n in sorted(one.items(), key=lambda x: -sum(x[0])):
        need = Counter(pattern)
        n = min(n, *(left[size] // k for size, k in need.items()))
        if n > 0:
            child.add(pattern, n)
            for size, k in need.items():
                left[size] -= n * k
    for size, n in shuffled({s: n for s, n in left.items() if n}, rng, rng.choice((0.02, 0.5))):
        child.place(size, n)
    return child


def mutated(bins: dict, capacity: int, rng: random.Random) -> Packing:
    """Empties some of the least filled bins and best-fits their pieces, in an order that is nearly by length or not."""
    out, displaced = Packing(capacity), Counter()
    order, first = sorted(bins.items(), key=lambda x: sum(x[0])), rng.randint(2, 5)
    for k, (pattern, n) in enumerate(order):
        gone = n if k < first or rng.random() < 0.05 else 0
        if gone < n:
            out.add(pattern, n - gone)
        if gone:
            for size in pattern:
                displaced[size] += gone
    for size, n in shuffled(displaced, rng, rng.choice((0.01, 0.3, 1.0))):
        out.place(size, n)
    return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: neither than all tokens fill, nor than there are pieces of over half the capacity, nor,
    for any size, than pieces that leave less than it and pieces of at least it need together."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    most, count, tokens = int(sizes[-1]), np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    count[sizes], tokens[sizes] = n, n * sizes
    count, tokens = np.cumsum(count), np.cumsum(tokens)
    best = -(-int(tokens[most]) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone, half = int(count[-1] - count[capacity - k]), int(count[capacity - k] - count[capacity // 2])
        room = half * capacity - int(tokens[capacity - k] - tokens[capacity // 2])
        rest = int(tokens[capacity // 2] - tokens[k - 1]) - room
        best = max(best, alone + half + max(0, -(-rest // capacity)))
    return best


def evolve(population: list[dict], counts: dict[int, int], capacity: int, seed: int, generations: int) -> list[dict]:
    """A population after some generations, best first. It ends early at the least number of bins there can be.

    Placing a length adds at most three patterns to a table, so a packing from the start has at most three for each
    length. A child of more than MOST_PATTERNS x capacity patterns doesn't enter, which bounds the tables.
    """
    rng = random.Random(seed)
    least = least_bins(counts, capacity)
    scored, number = [], count()

    def enter(p: Packing) -> None:
        scored.append((p.n_bins(), -p.fitness(), next(number), p.bins))

    for bins in population:
        p = Packing(capacity)
        for pattern, n in bins.items():
            p.add(pattern, n)
        enter(p)
    while len(scored) < POPULATION and not any(x[0] <= least for x in scored):
        enter(packed(shuffled(counts, rng, 0 if not scored else 0.1 * rng.random()), capacity))
    for _ in range(generations):
        scored.sort(key=lambda x: x[:3])
        if scored[0][0] <= least:
            break
        parents = scored[: max(2, POPULATION // 2)]
        scored = scored[:POPULATION]
        for _ in range(POPULATION):
            a, b = rng.sample(parents, 2)
            child = crossover(a[3], b[3], counts, capacity, rng)
            child = mutated(child.bins, capacity, rng) if rng.random() < 0.5 else child
            if len(child.bins) <= MOST_PATTERNS * capacity:
                enter(child)
    scored.sort(key=lambda x: x[:3])
    return [x[3] for x in scored[:POPULATION]]


def best_packing(spark: SparkSession, counts: dict[int, int], capacity: int = 4096) -> dict[tuple[int, ...], int]:
    """Islands evolve as Spark groups; after each epoch their best packings also enter the next island."""
    if not counts:
        return {}
    prepare(spark)

    def epoch(number: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            population = [pickle.loads(x) for x in rows.sort_values(["n_bins", "origin", "place"])["bins"] if x is not None]
            out = evolve(population, counts, capacity, number * ISLANDS + island, GENERATIONS)
            return pd.DataFrame({"island": island, "origin": island, "place": range(len(out)), "n_bins": [sum(x.values()) for x in out], "bins": [pickle.dumps(x) for x in out]})

        return run

    schema = "island int, origin int, place int, n_bins long, bins binary"
    rows = spark.range(ISLANDS).select(F.col("id").cast("int").alias("island"), F.lit(0).alias("origin"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("n_bins"), F.lit(None).cast("binary").alias("bins"))
    for number in range(EPOCHS):
        if number:
            rows = rows.withColumn("island", F.explode(F.when(F.col("place") < ELITES, F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).otherwise(F.array("island"))))
        # a range of its own for each island: a task each, which isn't merged with others
        rows = stored(rows.repartitionByRange(ISLANDS, "island").groupBy("island").applyInPandas(epoch(number), schema), "islands")
    best = rows.orderBy("n_bins", "island", "place").select("bins").first()
    return pickle.loads(best["bins"])


def layout(bins: dict[tuple[int, ...], int]) -> dict[int, tuple[list, list]]:
    """For each length: the ranks at which its uses of a pattern begin, and (first bin, offsets in the bin) of each."""
    out: dict[int, tuple[list, list]] = {}
    used: Counter = Counter()
    first = 0
    for pattern in sorted(bins):
        n, at, offsets = bins[pattern], 0, {}
        for size in pattern:
            offsets.setdefault(size, []).append(at)
            at += size
        for size, places in offsets.items():
            begins, uses = out.setdefault(size, ([], []))
            begins.append(used[size])
            uses.append((first, places))
            used[size] += n * len(places)
        first += n
    return out


def with_rank(rows: DataFrame, id_col: str) -> DataFrame:
    """rank: number of each piece among those of its length, from 0 and gapless. Counted in blocks by hash, so that a
    frequent length is spread over tasks.
    """
    blocks = max(16, partitions(rows.sparkSession))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_col, "piece"), F.lit(blocks)).cast("int"))
    before = rows.groupBy("length", "block").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    )
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy(F.col(id_col), "piece", "start", "ids_crc32"))
    return (
        rows.withColumn("own", own)
        .join(before.select("length", "block", F.coalesce("before", F.lit(0)).alias("before")), ["length", "block"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
        .drop("own", "before", "block")
    )


def place_pieces(rows: DataFrame, bins: dict[tuple[int, ...], int], id_col: str) -> DataFrame:
    """sequence_id and offset of each piece by its rank."""
    plan = layout(bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for size, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                begins, uses = plan[size]
                k = bisect_right(begins, rank) - 1
                first, places = uses[k]
                bin_, place = divmod(rank - begins[k], len(places))
                sequence.append(first + bin_)
                offset.append(places[place])
            keep = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    rows = stored(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # one row a length: at most capacity
    bins = best_packing(docs.sparkSession, counts, capacity)
    return place_pieces(with_rank(rows, id_col), bins, id_col)
