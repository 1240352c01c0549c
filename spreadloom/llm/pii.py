"""Personal data by plain patterns, and by contexts learned from what these find, with DataFrame functions only.

Base: mail and network addresses, card and telephone numbers by their form; a match that fails its test is dropped. They
are the seeds of a bootstrap: the words beside a seed are lexical patterns of its kind, and strings of a looser form (a
number without country code, an address with "(at)", a card number with a digit wrong, ...) are instances that patterns
may point to. Patterns and instances make a bipartite graph, scored in rounds: a pattern by the mean score of its
distinct instances, one more counted as wrong; an instance by the best of its patterns. Patterns need ``SUPPORT`` distinct
trusted instances and a score of ``TRUSTED``, so a context that stands beside wrong numbers as well as right ones, as any
frequent word does, gives nothing. Instances that reach ``TRUSTED`` are seeds of the next round. Scores are whole parts
per million: no order of summation changes them.

Matches are found in the text where it lies; only matches and their contexts are stored and shuffled. Edges are distinct
(pattern, instance), which copies of a text don't multiply; joins to the scores of a frequent pattern or instance are
salted.

Defined results: a null text is empty and has no spans; repeated rows, null ids and rows that share an id keep a row
each; texts are taken whole, of any length (patterns of base spans never backtrack over a run of characters); contexts
are the words within ``NEAR`` code points of a match, up to the match before or after it; an empty table gives no rows;
other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, text_or_empty
from .quality_rules import let

MILLION = 1_000_000
SALTS = 8
#: Code points beside a match in which its context is looked for.
NEAR = 80
#: Distinct trusted instances that a pattern needs, its least score, and the rounds of scoring.
SUPPORT, TRUSTED, ROUNDS = 5, 900_000, 3
#: Matches of one text whose places are added up in one fold.
BLOCK = 512


class Kind(NamedTuple):
    """A kind of personal data: pattern of the base, what a text needs to be searched at all, and the looser forms."""

    name: str
    pattern: str
    hint: str
    loose: str
    loose_hint: str


#: The forms. Those of the base are possessive and begin where a run of their characters begins, which finds
#: the same leftmost matches in one pass.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"@",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
        r"@|[(\[]at[)\]]",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]++(?:(?:\.|\[\.\])[0-9]++){3}",
        r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]\.|\[\.\]",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){13}",
        r"(?<![0-9])[0-9](?:[\x20./-]?[0-9])++",
        r"[0-9](?:[\x20./-]?[0-9]){11}",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        r"(?<![0-9A-Za-z+])\+?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-]?\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])",
        r"[0-9]{2}",
    ),
)
NAMES = [k.name for k in KINDS]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    values = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, -i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The test of a match of the base."""
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def plausible(kind: str, value: Column) -> Column:
    """The test of a looser match. What fails the base's test for its size alone is no candidate of that kind."""
    if kind == "card":
        return F.length(digits(value)).between(12, 19)
    if kind == "phone":
        return F.length(digits(value)).between(7, 15)
    return F.lit(True)


def failed(kind: str, value: Column) -> Column:
    """Whether a looser match is of the base's form and size, and wrong: evidence against a context."""
    if kind == "ip":
        return value.rlike(r"^[0-9.]+$")
    return F.length(digits(value)) >= 14 if kind == "card" else F.lit(False)


def instance(kind: str, value: Column) -> Column:
    """What spellings of one thing have in common."""
    if kind == "email":
        return F.lower(F.regexp_replace(F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", "."))
    if kind == "ip":
        return F.lower(F.regexp_replace(value, r"[\[\]]", ""))
    return digits(value)


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after) of the leftmost matches in order, in code points, with the text around
    each, up to its neighbours. The pieces between matches give the places: sums over blocks, then within them."""

    def placed(found: Column) -> Column:
        def of_pieces(pieces: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(pieces[i]) + F.length(m))
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
            total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
            sums = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
            starts = let(blocks, lambda bs: let(sums(F.transform(bs, total)), lambda at: F.flatten(F.transform(
                bs, lambda xs, b: F.transform(F.slice(sums(xs), 2, F.size(xs)), lambda x: x + at[b])))))
            # The sum of steps up to a match is its end.
            return let(starts, lambda ends: F.transform(found, lambda m, i: F.struct(
                (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("value"),
                F.substring(pieces[i], -NEAR, NEAR).alias("before"), F.substring(pieces[i + 1], 1, NEAR).alias("after"))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of_pieces))

    search = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(hint), search)


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns around a match: the word before it, the two before it, and the words at both sides. Digits are
    all one, A-Z are lower-cased; a match without a word before it has the word after it only."""
    plain = lambda c: F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[0-9]", "0")
    words = lambda c: F.filter(F.split(plain(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of_words(left: Column) -> Column:
        last, two, right = F.get(left, F.size(left) - 1), F.array_join(F.slice(left, -2, 2), " "), F.get(words(after), F.lit(0))
        return F.array_compact(F.array(
            F.when(last.isNotNull(), F.concat(last, F.lit(" _"))),
            F.when(F.size(left) > 1, F.concat(two, F.lit(" _"))),
            F.when(last.isNotNull() & right.isNotNull(), F.concat(last, F.lit(" _ "), right)),
            F.when(last.isNull() & right.isNotNull(), F.concat(F.lit("_ "), right)),
        ))

    return let(words(before), of_words)


def mention(kind: int, m: Column, seed: bool) -> Column:
    """A match as all matches are stored: kinds as numbers, contexts, and what it counts for: 2 if it is of the base, 1 if
    nothing is known, 0 if it fails a check."""
    return F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), instance(NAMES[kind], m["value"]).alias("value"),
        contexts(m["before"], m["after"]).alias("contexts"), F.lit(2).alias("mark") if seed else F.when(failed(NAMES[kind], m["value"]), 0).otherwise(1).alias("mark"),
    )


def mentions(text: Column) -> Column:
    """(base, loose) of a text: arrays of mentions by start and kind. A loose one overlaps none of the base."""

    def of(i: int, pattern: str, hint: str, test: Callable[[str, Column], Column], seed: bool) -> Column:
        kept = F.filter(matches(text, pattern, hint), lambda m: test(NAMES[i], m["value"]))
        return F.coalesce(F.transform(kept, lambda m: mention(i, m, seed)), F.array())

    base = [of(i, kind.pattern, kind.hint, holds, True) for i, kind in enumerate(KINDS)]
    loose = [of(i, kind.loose, kind.loose_hint, plausible, False) for i, kind in enumerate(KINDS)]

    def apart(b: Column) -> Column:
        free = lambda m: ~F.exists(b, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"]))
        return F.struct(F.array_sort(b).alias("base"), F.array_sort(F.filter(F.concat(*loose), free)).alias("loose"))

    return let(F.concat(*base), apart)


def salted(many: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows joined to the one row of their key, of which many may share one: dealt by a second column."""
    dealt = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def patterns(edges: DataFrame, instances: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(kind, context, n, trusted, score): patterns by their distinct instances, in parts per million."""
    good = F.col("score") >= TRUSTED
    quarters = F.when(good | (F.col("mark") == 0), 4).otherwise(1)
    sums = salted(edges, instances, ["kind", "value"], "context").groupBy("kind", "context").agg(
        F.count("*").alias("n"), F.sum(good.cast("long")).alias("trusted"), F.sum(quarters).alias("_of")
    )
    return sums.where(F.col("trusted") >= support).selectExpr("kind", "context", "n", "trusted", f"4 * {MILLION} * trusted DIV (_of + 4) AS score")


def bootstrap(found: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value): what trusted patterns point to, and other spellings of seeds, from mentions (kind, value, context,
    mark). Each round is a written table."""
    edges = stored(found.groupBy("kind", "value", "context").agg(F.max("mark").alias("mark")), "edges")
    instances = stored(edges.groupBy("kind", "value").agg(F.max("mark").alias("mark")).withColumn("score", F.when(F.col("mark") == 2, MILLION).otherwise(0).cast("long")), "instances")
    named = edges.where("context IS NOT NULL").select("kind", "value", "context")
    for _ in range(rounds):
        good = patterns(named, instances, support).where(F.col("score") >= TRUSTED).select("kind", "context", F.col("score").alias("of_pattern"))
        reached = salted(named, good, ["kind", "context"], "value").groupBy("kind", "value").agg(F.max("of_pattern").alias("reached"))
        grown = instances.join(reached, ["kind", "value"], "left").select(
            "kind", "value", "mark", F.greatest("score", F.coalesce("reached", F.lit(0))).alias("score")
        )
        before, instances = instances, stored(grown, "instances")
        dropped(before)
    trusted = stored(instances.where(F.col("score") >= TRUSTED).select("kind", "value"), "trusted")
    dropped(edges)
    dropped(instances)
    return trusted


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, by start and then kind."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: int) -> Column:
    return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: the id, the number of base spans of each kind, the digest of the base spans, all spans, and ``n_added``, the
    spans that contexts added."""
    # The row number is written before it is used, so it is the same wherever it is read again.
    found = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), mentions(text_or_empty(text_col)).alias("m")).select("row", "id", "m.*"), "mentions")
    every = found.select(F.inline(F.concat("base", "loose"))).select("kind", "value", "mark", F.explode_outer("contexts").alias("context"))
    trusted = bootstrap(every, support, rounds)
    loose = found.select("row", F.inline("loose")).select("row", "kind", "value", "start", "end")
    added = salted(loose, trusted, ["kind", "value"], "row").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    base = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    out = found.join(added, "row", "left").select(
        F.col("id").alias(id_col),
        *[counted(i).alias(f"n_{name}") for i, name in enumerate(NAMES)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
    return out
