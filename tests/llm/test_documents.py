"""WARC, quality rules, near-duplicates and sharding against versions by brute force."""

import base64
import gzip
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from spreadloom.llm import hamming_join, hash_tree, quality_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_warc_round_trip(spark):
    long = "WARC/1.1\r\n\r\n" * 9000 + "é🙂"
    rows = [(1, "u", "a", "x"), (2, "u\r\n", "a", "x"), (3, None, None, None), (4, "", "", ""), (5, "u", long, "x"), (6, "u", long + "!", "x"), (7, "u", "b", "x"), (7, "u", "b", "x"), (None, "u", "a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.read_archives(spark, _written(pages), with_payload=True).collect()
    keeper = {}
    for i, _, html, _ in rows:
        keeper[html or ""] = max(keeper.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        first = keeper[html or ""] == i
        want.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else keeper[html or ""], p if first else None))
    key = lambda r: (r[0], r[1])
    assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10**9).collect()} == {"response"}


def _written(pages):
    from spreadloom.llm.common import fresh_path

    path = fresh_path(pages.sparkSession, "warc")
    warc.write_archives(warc.with_roles(pages), path, records_per_file=3)
    return path


def test_segments_and_chunks_are_checked():
    assert warc.dechunked(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabc\r\n0\r\n\r\n")
    assert warc.joined([(2, b"b"), (1, b"a")], 2) == b"ab"
    for wrong in ([(1, b"a"), (3, b"b")], [(2, b"b")], [(1, b"a")]):
        with pytest.raises(ValueError):
            warc.joined(wrong, 2)


def test_archives_with_a_gzip_member_for_each_record():
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n" for n in (0, 5, 200_000)]
    data = b"".join(map(gzip.compress, records))
    assert [len(block) for _, block in warc.parsed(warc.inflated(data))] == [0, 5, 200_000] and warc.inflated(b"") == b""
    with pytest.raises(ValueError):
        warc.inflated(data[:-3])


def test_rules_keep_a_column_of_any_name(spark):
    text = " ".join(["the be to of and a long text with enough words"] * 8 + [f"w{k}" for k in range(100)])
    docs = spark.createDataFrame([(1, text, 7), (2, "short", 8)], "doc_id long, text string, _quality int")
    assert [(r.doc_id, r._quality) for r in quality_rules.keep_good(docs).collect()] == [(1, 7)] and quality_rules.keep_good(docs).columns == docs.columns


def test_quality_rules_equal_sql_and_brute_force(corpus, nothing):
    got = {str(r.doc_id): r for r in quality_rules.quality_report(corpus).collect()}
    con = duckdb.connect()
    con.register("documents", corpus.toPandas())
    sql = con.execute(quality_rules.duckdb_sql()).fetchdf()
    con.close()
    for d in corpus.collect():
        words = WORD.findall(d.text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        places = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)} if len(words) < 2000 else None
        lines = [x for x in (d.text or "").split("\n") if WORD.search(x)]
        r = got[str(d.doc_id)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in d.text or "")
        assert places is None or r.n_repeat_words == len(places)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    for row in sql[sql.doc_id.notna()].itertuples():
        r = got[str(int(row.doc_id))]
        assert (r.n_words, r.n_repeat_words, r.n_symbols, r.base_failed, r.kept) == (row.n_words, row.n_repeat_words, row.n_symbols, row.base_failed, row.kept)
    assert quality_rules.quality_report(nothing).count() == 0


def components(texts, width, percent):
    sets = {}
    for i, text in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    label = {i: i for i in sets}
    moved = True
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, nothing, width, percent, monkeypatch):
    monkeypatch.setattr(hamming_join, "BLOCK", 3)
    base = " ".join(f"w{k}" for k in range(60)).split()
    near = [(100 + k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(0, 60, 4)]  # linked in part, by way of the first
    chain = [(300 + k, " ".join(f"c{j}" for j in range(k, k + 60))) for k in range(0, 30, 3)]
    rows = [(r.doc_id, r.text) for r in corpus.collect()] + [(99, " ".join(base))] + near + chain
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "1 AS node", "2 AS label", "3 AS component_id")
    got = hamming_join.near_duplicates(docs, width, percent).collect()
    want = components([(i, t) for i, t in rows if i is not None], width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert ((r.n_shingles, r.component_id), r.kept) == (want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert hamming_join.near_duplicates(nothing, width, percent).count() == 0


def law(doc_id, tree):
    def draw(path):
        return -math.log((int(hashlib.md5(f"{'null' if doc_id is None else doc_id}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    racks = {(r, k): shards for r, of in tree.items() for k, shards in of.items()}
    r, k = min(racks, key=lambda at: draw("/".join(at)) / sum(racks[at].values()))
    return min((draw(f"{r}/{k}/{s}") / w, s) for s, w in racks[r, k].items())[1]


def test_sharding(corpus, nothing):
    rows = hash_tree.shard(corpus).collect()
    more = hash_tree.grown(hash_tree.EIGHT, "r1", "more", 8)
    slots = {}
    for r in rows:
        assert (r["shard"], r.grown_shard) == (law(r.doc_id, hash_tree.EIGHT), law(r.doc_id, more)) and r.grown_shard in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    want = sorted((str(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in corpus.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert hash_tree.shard(nothing).count() == 0


def moves(spark, region):
    """(from, to) of the rows that move when the racks of the first region are given other weights."""
    ids = spark.range(3000).selectExpr("id AS doc_id", "'' AS text")
    rows = hash_tree.shard(ids, hash_tree.EIGHT, {**hash_tree.EIGHT, "r0": region}).collect()
    return [(r["shard"], r.grown_shard) for r in rows if r["shard"] != r.grown_shard]


def test_a_heavier_rack_moves_rows_only_into_itself(spark):
    moved = moves(spark, {"a": {0: 2.0, 1: 1.0}, "b": {2: 1.0, 3: 1.0}})
    assert {to for _, to in moved} <= {0, 1} and {a for a, _ in moved} >= {1, 2, 3, 4, 5, 6, 7}
    arrived = [m for m in moved if m[0] > 1]
    assert abs(len(arrived) - 3000 * (3 / 9 - 2 / 8)) < 80 and all(m == (1, 0) for m in moved if m[0] < 2)


def test_weights_that_shift_inside_a_rack_move_rows_only_inside_it(spark):
    moved = moves(spark, {"a": {0: 1.5, 1: 0.5}, "b": {2: 1.0, 3: 1.0}})
    assert {*moved} == {(1, 0)} and abs(len(moved) - 3000 / 4 / 4) < 60


def test_a_shard_without_weight_gets_no_rows(spark):
    moved = moves(spark, {"a": {0: 2.0, 1: 0.0}, "b": {2: 1.0, 3: 1.0}})
    assert {*moved} == {(1, 0)}
