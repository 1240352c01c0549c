"""BPE, token counts and packing against the tokenizers library."""

import hashlib
import json
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spreadloom.llm import bpe, packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
POOL = [*"ab '\n\t\x85\x1c é中Σİß1٣½!?.  　🙂", "<|endoftext|>", "'s", "'re", "'ll", "'r", "  ", "hello", "the"]


def ids_of(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 20))) for _ in range(2000)]


def test_encoder_equals_the_library(texts):
    coder, ids, decode = bpe.Encoder(BYTES, memo=50), ids_of(BYTES), Tokenizer.from_file(BYTES).decode
    for text in texts:
        assert coder.encode(text) == packed(ids(text))
        assert coder.decode(coder.encode(text)) == decode(ids(text), skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_counter_equals_the_library(texts, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    counter, ids = token_counts.Counter(BYTES, limit=500, memo=100), ids_of(BYTES)
    assert counter.count(texts) == [len(ids(t)) for t in texts]


def test_word_ids_equal_the_library(texts):
    coder, ids = packing.WordIds(WORDS), ids_of(WORDS)
    for text in texts:
        assert coder.encode(text) == packed(ids(text))


def test_round_trip_query(corpus, nothing):
    ids = ids_of(BYTES)
    want = sorted((str(r.doc_id), len(ids(r.text)), hashlib.sha256(packed(ids(r.text))).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in corpus.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(corpus, BYTES).collect()) == want
    assert bpe.round_trip(nothing, BYTES).count() == 0
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(corpus, BYTES), BYTES).collect()}
    assert all(texts[r.doc_id] == (r.text or "") for r in corpus.collect())


def test_token_counts_query(corpus, nothing):
    ids = ids_of(BYTES)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 1024) for r in corpus.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(corpus, BYTES).collect()) == want
    assert token_counts.token_counts(nothing, BYTES).count() == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "abcab" * 40_000, "é" * 9_000, "ab" * 2_500 + "x" + "ba" * 2_500])
def test_counts_of_chunks_of_a_long_pre_token_compose(text):
    counter = token_counts.Counter(BYTES)
    assert counter.count([text]) == [len(ids_of(BYTES)(text))]


def test_random_letters_in_chunks():
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    assert token_counts.Counter(BYTES).count([text]) == [len(ids_of(BYTES)(text))]


def test_another_byte_level_file_is_refused(tmp_path):
    spec = json.loads(open(BYTES, encoding="utf-8").read())
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "end", "id": 1}])):
        (tmp_path / f"{key}.json").write_text(json.dumps({**spec, key: value}))
        with pytest.raises(ValueError):
            bpe.Encoder(str(tmp_path / f"{key}.json"))


def check_packing(rows, docs, capacity):
    ids = ids_of(WORDS)
    want = sorted((str(d.doc_id), k, k * capacity, len(own), zlib.crc32(packed(own))) for d in docs for all_ in [[*ids(d.text), 1]] for k in range(-(-len(all_) // capacity)) for own in [all_[k * capacity : (k + 1) * capacity]])
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= capacity
    return len(bins)


def test_packing_query(corpus, nothing):
    docs = corpus.collect()
    for capacity in (4096, 100):
        rows = packing.pack(corpus, WORDS, capacity).collect()
        n = check_packing(rows, docs, capacity)
        assert n <= 1 + 1.02 * -(-sum(r.length for r in rows) // capacity)
    assert packing.pack(nothing, WORDS).count() == 0


def test_packing_reaches_the_least_number_of_bins(spark):
    counts = {6: 3, 4: 3, 5: 4, 3: 4, 2: 4}  # 66 of 70: best fit alone may need one more
    bins = packing.best_packing(spark, counts, 10)
    assert sum(bins.values()) == 7
    used = {}
    for pattern, n in bins.items():
        assert sum(pattern) <= 10
        for size in pattern:
            used[size] = used.get(size, 0) + n
    assert used == counts


def triples(capacity, bins, seed):
    """Pieces that fill so many bins by threes, which best fit doesn't find."""
    rng, counts = random.Random(seed), {}
    for _ in range(bins):
        a, b = (rng.randint(capacity * 26 // 100, capacity * 36 // 100) for _ in "ab")
        for size in (a, b, capacity - a - b):
            counts[size] = counts.get(size, 0) + 1
    return counts


@pytest.mark.parametrize(("capacity", "bins", "seed"), [(100, 40, 1), (1000, 30, 4)])
def test_the_search_beats_best_fit_and_more_epochs_help(spark, monkeypatch, capacity, bins, seed):
    counts = triples(capacity, bins, seed)
    alone = packing.packed(sorted(counts.items(), reverse=True), capacity).n_bins()
    found = []
    for epochs in (1, 3):
        monkeypatch.setattr(packing, "EPOCHS", epochs)
        best = packing.best_packing(spark, counts, capacity)
        used = {}
        for pattern, n in best.items():
            assert sum(pattern) <= capacity
            for size in pattern:
                used[size] = used.get(size, 0) + n
        assert used == counts
        found.append(sum(best.values()))
    assert packing.least_bins(counts, capacity) == bins <= found[1] <= found[0] < alone


def test_an_elite_from_another_island_lifts_the_next():
    counts = triples(50, 60, 5)
    start = packing.packed(sorted(counts.items(), reverse=True), 50).bins
    elite = packing.evolve([], counts, 50, 1, 30)[0]
    with_it, without = (packing.evolve([*extra, start], counts, 50, 7, 1)[0] for extra in ([elite], []))
    assert sum(with_it.values()) <= sum(elite.values()) < sum(without.values())


def test_no_packing_has_fewer_bins_than_the_bound():
    assert packing.least_bins({6: 5}, 10) == 5 and packing.least_bins({10: 2, 1: 1}, 10) == 3 and packing.least_bins({7: 4, 4: 4, 3: 1}, 10) == 6
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 20): rng.randint(1, 5) for _ in range(8)}
        assert packing.least_bins(counts, 20) <= packing.packed(sorted(counts.items(), reverse=True), 20).n_bins()


def test_another_kind_of_file_is_refused(tmp_path):
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[a-z]+"
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="pre-token"):
        packing.WordIds(str(tmp_path / "other.json"))


def test_equal_packings_in_a_population():
    counts = {700: 3, 3000: 2, 50: 1}
    for seed in range(4):
        for bins in packing.evolve([packing.packed(sorted(counts.items(), reverse=True), 4096).bins] * 8, counts, 4096, seed, 3):
            assert sum(n * sum(p) for p, n in bins.items()) == sum(s * n for s, n in counts.items())


def test_crossover_keeps_every_piece():
    rng = random.Random(2)
    counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(30)}
    a, b = (packing.packed(packing.shuffled(counts, rng, 1.0), 50).bins for _ in range(2))
    for child in (packing.crossover(a, b, counts, 50, rng), packing.mutated(a, 50, rng)):
        used = {}
        for pattern, n in child.bins.items():
            for size in pattern:
                used[size] = used.get(size, 0) + n
        assert used == counts
