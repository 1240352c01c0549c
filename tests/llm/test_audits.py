"""Personal data, filter interactions and source divergence against versions by brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import filter_audit, pii, source_divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def right(kind, value):
    d = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if right(k, m[0])]
    return sorted(found, key=lambda s: (s[0], [*BASE].index(s[1])))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def with_luhn(rng, n=16):
    head = "".join(rng.choices("0123456789", k=n - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


def check_base(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), (texts[r.doc_id][:300], want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(Counter(k for _, k, _ in want)[k] for k in BASE)
        assert set(written(want).split(",")) <= set(r.spans.split(",")) or not want


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "B.", "@", "@x.y", ".", "-", "_", "1", "23", "255.", "256.", "+", "+1", " ", "  ", "(", ")", "é", "🙂", "\n", "1.2.3.4", "4111 1111 1111 1111", "a@b.c", "+1 (555) 010-99", "%"]
    texts = dict(enumerate("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)))
    texts |= {len(texts) + i: t for i, t in enumerate(["", "a" * 5_000 + "@", "9" * 5_000, "1.2.3.4 " * 3000, "a@b" + ".c" * 50_000, "+1" + " " * 50_000, "é" * 700 + " x@y.z"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    check_base(got, texts)


def brute_added(found, support, rounds):
    """Accepted (kind, value) of mentions (kind, value, context or None, mark)."""
    of_pattern, mark = defaultdict(set), {}
    for kind, value, context, own in found:
        mark[kind, value] = max(mark.get((kind, value), 0), own)
        if context is not None:
            of_pattern[kind, context].add(value)
    score = {k: 10**6 * (m == 2) for k, m in mark.items()}
    for _ in range(rounds):
        reached = {}
        for (kind, context), values in of_pattern.items():
            good = [v for v in values if score[kind, v] >= 900_000]
            bad = [mark[kind, v] for v in values if score[kind, v] < 900_000]
            of = 4 * len(good) + sum(4 if m == 0 else 1 for m in bad) + 4
            mean = 4 * 10**6 * len(good) // of
            if len(good) >= support and mean >= 900_000:
                for v in values:
                    reached[kind, v] = max(reached.get((kind, v), 0), mean)
        score = {k: max(v, reached.get(k, 0)) for k, v in score.items()}
    return {k for k, v in score.items() if v >= 900_000}


def test_contexts_find_unseen_identifiers_and_leave_others(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        rows += [f"Reach me: phone {rng.choice('abcdefg')} tel: +49 {rng.randint(10**9, 10**10 - 1)} thanks", f"pay with Card no. {with_luhn(rng)} today", f"the {with_luhn(rng)} or"]
        rows += [f"the {rng.randint(10**15, 10**16 - 1)} or", f"write to Mail: bob{i}@mail.example.org please", f"version {rng.randint(1000000, 9999999)} of it"]
    planted = ["tel: 030 1234567 ok", "Card no. 4111.1111.1111.1112 ok", "my Mail: eve (at) mail [dot] example.org ok", "Mail: admin@intranet ok"]
    clean = ["order 030 7654321 ok", "sum 1111.2222.3333.4444 ok", "meet (at) noon", "the 4111111111111113 or", "built 2024.01.02.03 now"]
    # A second round: what the first context points to makes a second context trusted.
    planted += [f"tel: 0{n} 55500{n:02d} ok" for n in range(11, 25)] + [f"ring 0{n} 55500{n:02d} then" for n in range(11, 25)] + ["ring 0777 123456 then"]
    texts = dict(enumerate(rows + planted + clean + [None, "", "tel: 030 1234567 ok"]))
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, kind string, row long").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    check_base(got.values(), {k: v or "" for k, v in texts.items()})
    for k, v in texts.items():
        assert got[k].n_added == (v in planted), (v, got[k])
    assert got[len(rows)].spans == "phone:5:16" and got[len(rows) + 2].spans == "email:9:40"
    found = docs.select(pii.mentions(F.coalesce("text", F.lit(""))).alias("m")).select(F.inline(F.concat("m.base", "m.loose"))).select("kind", "value", "mark", F.explode_outer("contexts").alias("context"))
    plain = [(r.kind, r.value, r.context, r.mark) for r in found.collect()]
    for support, rounds in ((5, 3), (2, 1), (30, 2)):
        assert {(r.kind, r.value) for r in pii.bootstrap(found, support, rounds).collect()} == brute_added(plain, support, rounds)


def test_personal_data_of_odd_tables(spark, corpus, nothing):
    got = pii.personal_data(corpus).collect()
    assert len(got) == corpus.count() and all(r.n_added == 0 for r in got) and pii.personal_data(nothing).count() == 0
    assert pii.personal_data(nothing).columns[:6] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


@pytest.fixture(scope="module")
def marked(spark, corpus):
    rows = [(1, 1, 0), (1, None, None), (2, 0, 1), (3, 1, 1), (3, 0, 0), (40, 1, 1), (None, 1, 1), (47, 1, 0), (999, 1, 1), (44, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_audit(docs, labels):
    first, good, toxic = {}, Counter(), Counter()
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    for r in labels:
        good[r.doc_id] |= r.quality == 1
        toxic[r.doc_id] |= r.toxic == 1
    parts = defaultdict(list)
    for r in docs:
        t = r.text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": r.doc_id is not None and t in first and r.doc_id > first[t],
        }
        known = r.doc_id is not None
        parts[r.source or ""].append((fails, known and good[r.doc_id], known and toxic[r.doc_id]))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                failing = sum(x[0][f] for x in rows)
                shapley[part, f] += len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in rows)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(bool(x[1]) for x in gone), sum(bool(x[2]) for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_interactions(spark, corpus, marked, nothing):
    more = spark.createDataFrame([(k, t, "en", s, 1, "p", "l") for k, (t, s) in enumerate([("A B", "s"), ("#", "t"), ("A B", "t"), ("A B", None), ("", "t"), ("A B", "")] * 3, 60)], corpus.schema)
    docs = corpus.unionByName(more).unionByName(corpus.where("doc_id IS NULL OR doc_id = 47"))
    want = plain_audit(docs.collect(), marked.collect())
    assert sorted(map(tuple, filter_audit.interactions(docs, marked).collect())) == want and len({r[0] for r in want}) == 3
    assert filter_audit.interactions(nothing, marked).count() == 0
    assert filter_audit.interactions(docs, marked.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    one = filter_audit.interactions(docs, marked, [F.length("text") < 3]).collect()
    assert {r.filter_order for r in one} == {"AB", "BA"} and len(one) == 2 * 2 * 3


def plain_divergence(docs, least, ranks):
    count, holds, groups = Counter(), defaultdict(int), set()
    for r in docs:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        for w in words:
            count[lang, source, w] += 1
        for w in set(words):
            holds[lang, w] += 1
    out = []
    for lang, source in groups:
        kept = [w for (of, w), n in holds.items() if of == lang and n >= least]
        mine = [s for of, s in groups if of == lang]
        by = {s: [count[lang, s, w] for w in kept] for s in mine}
        whole = [sum(by[s][i] for s in mine) for i in range(len(kept))]
        share = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]
        p = share(by[source])
        pairs = [(sum((a - b) ** 2 // b for a, b in zip(p, share(by[s]))), s) for s in mine if s != source]
        terms = [((a - b) ** 2 // b, w) for a, b, w, n in zip(p, share(whole), kept, by[source]) if n > 0 and a > b]
        for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, w, v, k) for k, (v, w) in enumerate(ordered[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(11)
    words = ["the", "The", "of", "é", "É", "naïve", "z" * 30, "中文", "a1b", "x_y", "\U0001F600", "ﬀ", "q"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(k, " ".join(rng.choices(words[: rng.randint(1, 39)], k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "é"]), 1, "p", "l") for k in range(300)]
    rows += [(k, "123 !", "xx", s, 1, "p", "l") for k, s in ((400, "s"), (401, "t"))] + [(402, "alone", "yy", "s", 1, "p", "l")] + rows[:5]
    return rows


def test_source_divergence(spark, sources, corpus, nothing, monkeypatch):
    docs = spark.createDataFrame(sources, corpus.schema).repartition(3)
    for least, ranks in ((3, 200), (1, 2), (60, 7)):
        want = plain_divergence(docs.collect(), least, ranks)
        assert sorted(map(tuple, source_divergence.divergence(docs, least, ranks).collect())) == want
    monkeypatch.setattr(source_divergence, "FEW", 2)  # tables of groups aren't broadcast
    assert sorted(map(tuple, source_divergence.divergence(docs, 3, 5).collect())) == plain_divergence(docs.collect(), 3, 5)
    assert source_divergence.divergence(nothing).count() == 0


def test_sql_agrees(spark, sources, corpus, marked, tmp_path):
    docs = spark.createDataFrame(sources, corpus.schema).unionByName(corpus)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    marked.coalesce(1).write.parquet(str(tmp_path / "l"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    for frame, sql in ((source_divergence.divergence(docs), source_divergence.duckdb_sql()), (filter_audit.interactions(docs, marked), filter_audit.duckdb_sql())):
        assert sorted(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({sql})").fetchall()) == sorted(map(tuple, frame.collect()))
