"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers, one after the other. ``SPLIT`` reads character classes and marks where pre-tokens
begin. ``Counter`` reads the bytes of a pre-token; its transitions carry the change of the number of emitted tokens.
Its states are compiled when first reached: a state is the longest suffix of what was read that some vocabulary
string starts with, and, for each place inside that suffix, the last token and the number of tokens of the text up to
there. That is enough for the next step: a token that ends later begins inside the suffix, and the tokens of a text
are the one sequence whose neighbours all stay as they are when merged on their own.

A pre-token of more than LONG bytes is read in chunks as well: each chunk has a map from entry state to exit state and
count, for the entry states that are met, and maps compose in rounds. For the splitter, a text is cut into chunks of
equal length. The map from entry state to exit state of every chunk is found for all
chunks at once, the maps of a text are composed by a parallel prefix scan, and with the entry states known all chunks
are read at once. One map over the texts, no shuffle; a very long text is many chunks.

Defined results: a null text counts as empty, with no bytes and no tokens; special strings of the file inside a text
count one token each; repeated rows each keep a row; columns beside the id and the text are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, pretokens
from .common import SLICE, prepare, text_or_empty

CHUNK = 512
#: Bytes of a pre-token that is read in chunks, and bytes before a chunk that guess its entry state.
LONG, WARM = 4096, 64
#: Characters handled at once in a task; a longer text is handled alone.
BLOCK = 2_000_000
#: Compiled states of a worker; beyond it compilation starts anew, which changes no result.
STATES = 200_000

# Character classes and states of the pre-token transducer.
LETTER, SHORT, BEFORE_E, BEFORE_L, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, L, PAD = range(12)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_E, QUOTE_L, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(11)
N_STATES = 11
HERE, BACK = 1, 2  # a pre-token begins at this character; at the one before it


def compile_split() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class."""
    step, marks = np.zeros((N_STATES, 12), np.uint8), np.zeros((N_STATES, 12), np.uint8)
    letters = (LETTER, SHORT, BEFORE_E, BEFORE_L, E, L)
    run = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBERS, QUOTE: IN_OTHER, OTHER: IN_OTHER}

    def put(state: int, c: int, to: int, mark: int = 0) -> None:
        step[state, c], marks[state, c] = to, mark

    for c in range(11):
        anew = {SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: AT_QUOTE}.get(c, run.get(c))
        for state in (FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, ONE_WHITE):
            put(state, c, anew, HERE)
        put(MORE_WHITE, c, anew, HERE | BACK)
        put(QUOTE_E, c, anew, HERE | BACK)
        put(QUOTE_L, c, anew, HERE | BACK)
        if c in run:  # a single space joins what follows
            put(ONE_SPACE, c, run[c])
            put(MORE_SPACE, c, run[c], BACK)
    for c in (SPACE, WHITE):
        for state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
            put(state, c, MORE_SPACE if c == SPACE else MORE_WHITE)
    for c in letters:
        put(IN_LETTERS, c, IN_LETTERS)
        for state in (QUOTE_E, QUOTE_L):
            put(state, c, IN_LETTERS, BACK)
    put(IN_NUMBERS, NUMBER, IN_NUMBERS)
    for state in (IN_OTHER, AT_QUOTE):
        for c in (QUOTE, OTHER):
            put(state, c, IN_OTHER)
    put(AT_QUOTE, SHORT, FRESH)
    put(AT_QUOTE, BEFORE_E, QUOTE_E)
    put(AT_QUOTE, BEFORE_L, QUOTE_L)
    put(QUOTE_E, E, FRESH)
    put(QUOTE_L, BEFORE_L, FRESH)
    step[:, PAD] = np.arange(N_STATES)
    return step, marks


@lru_cache(maxsize=1)
def split_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, next state and marks."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    for text, kind in (("smtd", SHORT), ("rv", BEFORE_E), ("l", BEFORE_L), ("e", E), (pretokens.WHITE, WHITE), (" ", SPACE), ("'", QUOTE)):
        for c in text:
            classes[ord(c)] = kind
    return classes, *compile_split()


def chunk_maps(classes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Exit state of each chunk (a column of classes) for each entry state. Most chunks soon forget their entry state;
    from there on one state is followed.
    """
    n = classes.shape[1]
    states = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n, 1)
    warm = min(8, len(classes))
    for row in classes[:warm]:
        states = step[states, row]
    same = (states == states[0]).all(0)
    one = states[0].copy()
    for row in classes[warm:]:
        one = step[one, row]
    slow = np.flatnonzero(~same)
    if len(slow):
        rest = states[:, slow]
        for row in classes[warm:, slow]:
            rest = step[rest, row]
        states[:, slow] = rest
    states[:, same] = one[same]
    return states


def scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Entry state of each chunk: inclusive prefix scan by composition of maps, in rounds of doubling distance; first:
    number of the first chunk of each chunk's text.
    """
    n = maps.shape[1]
    place, maps = np.arange(n) - first, maps.copy()
    d = 1
    while d <= (place.max() if n else 0):
        at = np.flatnonzero(place >= d)
        maps[:, at] = maps[maps[:, at - d], at]
        d *= 2
    return np.where(place > 0, maps[FRESH, np.maximum(np.arange(n) - 1, 0)], FRESH).astype(np.uint8)


def pretoken_starts(texts: list[str]) -> list[list[int]]:
    """Where the pre-tokens of each text begin, and its length."""
    class_of, step, marks = split_tables()
    lengths = np.array([len(t) for t in texts])
    flat = class_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum(lengths) - lengths
    chunks = -(-lengths // CHUNK)
    n = int(chunks.sum())
    text_of = np.repeat(np.arange(len(texts)), chunks)
    first = (np.cumsum(chunks) - chunks)[text_of]
    begin = starts[text_of] + (np.arange(n) - first) * CHUNK
    end = np.minimum(begin + CHUNK, (starts + lengths)[text_of])
    at = np.arange(min(CHUNK, int(lengths.max(initial=0))))[:, None] + begin
    classes = np.where(at < end, flat[np.minimum(at, max(len(flat) - 1, 0))], PAD) if n else np.zeros((0, 0), np.uint8)
    state = scan(chunk_maps(classes, step), first)
    marked = np.zeros(classes.shape, np.uint8)
    for k, row in enumerate(classes):
        marked[k] = marks[state, row]
        state = step[state, row]
    here = np.zeros(len(flat) + 1, bool)
    k, c = np.nonzero(marked & HERE)
    here[begin[c] + k] = True
    k, c = np.nonzero(marked & BACK)
    here[begin[c] + k - 1] = True
    if n:  # what is still pending at the end of a text
        last = np.flatnonzero(np.arange(n) + 1 - first == chunks[text_of])
        pending = last[np.isin(state[last], (QUOTE_E, QUOTE_L))]
        here[end[pending] - 1] = True
    found = np.flatnonzero(here[: len(flat)])
    cut = np.searchsorted(found, [*starts, len(flat)])
    return [[*(found[a:b] - s).tolist(), int(m)] for a, b, s, m in zip(cut, cut[1:], starts, lengths)]


class Counter:
    """The transducer from the bytes of a pre-token to the number of its tokens."""

    def __init__(self, path: str, limit: int = STATES, memo: int = 400_000):
        self.coder, self.limit = bpe.Encoder(path), limit
        self.words = pretokens.Memo(self.count_word, memo)
        self.pairs: dict[tuple[int, int], bool] = {}
        own = [i for i, b in enumerate(self.coder.bpe.token_bytes) if b and b.decode("utf-8", "replace") not in self.coder.bpe.special]
        self.tokens = {b: i for i in own if self.coder.merge(b := self.coder.bpe.token_bytes[i]) == [i]}
        self.prefixes = {b[:k] for b in self.tokens for k in range(len(b) + 1)}
        self.reset()

    def reset(self) -> None:
        # a state: [suffix, ((last token, tokens more than at the end), ...) for each place in the suffix, its transitions]
        self.start = (b"", ((-1, 0),), {})
        self.states = {self.start[:2]: self.start}

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what merging gives for their bytes."""
        if left < 0:
            return True
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= 2 * self.limit:
                self.pairs.clear()
            text = self.coder.bpe.token_bytes
            found = self.pairs[left, right] = self.coder.merge(text[left] + text[right]) == [left, right]
        return found

    def compile(self, state: tuple, byte: int) -> tuple:
        """The transition of a state by a byte: (state, change of the count)."""
        suffix, places, steps = state
        grown = suffix + bytes((byte,))
        for k in range(len(grown)):
            token = self.tokens.get(grown[k:])
            if token is not None and self.stays(places[k][0], token):
                change = places[k][1] + 1
                break
        else:
            raise AssertionError("every byte is a token")
        cut = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
        key = (grown[cut:], (*[(last, n - change) for last, n in places[cut:]], (token, 0)))
        if (to := self.states.get(key)) is None:
            to = self.states[key] = (*key, {})
        steps[byte] = found = (to, change)
        return found

    def read(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """Exit state, and the change of the count."""
        if len(self.states) > self.limit:
            self.reset()
        n = 0
        for byte in data:
            step = state[2].get(byte)
            state, change = step or self.compile(state, byte)
            n += change
        return state, n

    def count_word(self, word: str) -> int:
        data = word.encode()
        return self.read(self.start, data)[1] if len(data) <= LONG else self.count_long(data)

    def count_long(self, data: bytes) -> int:
        """The count of a pre-token of many chunks. The map of a chunk, from entry state to exit state and count, is made
        for the state that WARM bytes before it lead to; equal chunks share their map. Neighbouring maps are composed
        in rounds, and an entry state that a map lacks is added to it when it is met.
        """
        parts = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        known: dict[bytes, dict] = {}

        def leaf(part: bytes, state: tuple) -> tuple[tuple, int]:
            own = known.setdefault(part, {})
            if (found := own.get(state[:2])) is None:
                found = own[state[:2]] = self.read(state, part)
            return found

        def apply(node: tuple, state: tuple) -> tuple[tuple, int]:
            own, left, right = node
            if right is None:
                return leaf(left, state)
            if (found := own.get(state[:2])) is None:
                middle, n = apply(left, state)
                out, more = apply(right, middle)
                found = own[state[:2]] = (out, n + more)
            return found

        nodes, entries = [({}, part, None) for part in parts], [self.start, *(self.read(self.start, data[k - WARM : k])[0] for k in range(CHUNK, len(data), CHUNK))]
        for node, entry in zip(nodes, entries):
            apply(node, entry)
        while len(nodes) > 1:
            pairs = [({}, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
            entries = entries[::2]
            for node, entry in zip(pairs, entries):
                apply(node, entry)
            nodes = pairs
        return apply(nodes[0], self.start)[1]

    def count(self, texts: list[str]) -> list[int]:
        special = self.coder.split_special
        parts, of, n = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            for part in special.split(text) if special and "<" in text else [text]:
                if part in self.coder.bpe.special:
                    n[k] += 1
                elif part:
                    parts.append(part)
                    of.append(k)
        self.words = self.words.renewed()
        count = self.words.__getitem__
        for k, part, at in zip(of, parts, pretoken_starts(parts) if parts else []):
            n[k] += sum(map(count, [part[a:b] for a, b in zip(at, at[1:])]))
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    yield held


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each text."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            for part in (batch.slice(k, 8 * SLICE) for k in range(0, batch.num_rows, 8 * SLICE)):
                n = [x for block in blocks(part.column(2).to_pylist()) for x in machine.count(block)]
                tokens = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tokens, pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql import functions as F

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(work, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
