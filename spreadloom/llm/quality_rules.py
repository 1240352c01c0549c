"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds a ratio of two counts of a text, in percent, so that all comparisons are between whole numbers. Counts
are built from array functions; intermediate arrays are bound once by ``let``. Nothing is shuffled.

Defined results: a null text has no words; a text without words fails the base; texts of any length are taken whole;
repeated rows each keep a row; an empty table gives no rows; other columns, whatever their names, are passed on or not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: White space between words, and the characters that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages the corpus is kept in (English, French, German, Spanish).
STOP_WORDS = (
    "the be to of and that have with is in it for on as are was this by from at or an not a "
    "le la les de des du un une et en que qui dans pour par sur est au avec ne pas "
    "der die das und ist ein eine von zu mit den dem im auf für nicht als auch sich "
    "el los las del y es una por con para se no al lo como"
).split()


class Rule(NamedTuple):
    """100 * count is to be at least low and at most high percent of ``of`` (None: unbounded)."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None


RULES = (
    Rule("length", "n_words", "one", 50_00, 1_000_000_00),
    Rule("mean_word_length", "word_chars", "n_words", 2_00, 12_00),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("shouting", "n_shouts", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "one", 2_00, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("bullet_lines", "n_bullets", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipses", "n_lines", None, 30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value that is used more than once, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more: windows sorted, equal neighbours, places covered."""

    def covered(windows: Column) -> Column:
        at = F.filter(F.transform(windows, lambda x, i: F.when((F.get(windows, i + 1)["w"] == x["w"]) | (F.when(i > 0, F.get(windows, i - 1)["w"]) == x["w"]), x["i"])), lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def counted(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, counted))


def counts(text: Column) -> Column:
    """Struct of all counts of a text."""

    def of_words(words: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            lower = F.array_distinct(F.transform(words, lambda w: F.lower(w)))
            values = {
                "one": F.lit(1),
                "n_words": F.size(words),
                "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
                "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
                "n_shouts": F.size(F.filter(words, lambda w: w.endswith("!!"))),
                "n_stop_words": F.size(F.array_intersect(lower, F.array(*map(F.lit, STOP_WORDS)))),
                "n_lines": F.size(lines),
                "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                "n_bullets": F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• "))),
                "n_ellipses": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
                "n_repeat_words": repeated_words(words),
            }
            return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

        return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines)

    return let(F.filter(F.split(text, SPACES), lambda w: w != ""), of_words)


def verdict(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether all rules of the table hold."""
    held = F.lit(True)
    for rule in rules:
        value, of = c[rule.count] * 100, c[rule.of]
        if rule.low is not None:
            held &= value >= of * rule.low
        if rule.high is not None:
            held &= value <= of * rule.high
    return held


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (c["n_repeat_words"] * 100 > c["n_words"] * 50)


def quality(rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> Column:
    """A struct of a row: counts, base_failed and kept."""

    def judged(c: Column) -> Column:
        failed = base_failed(c)
        return c.withField("base_failed", failed).withField("kept", ~failed & verdict(c, rules))

    return let(counts(text_or_empty(text_col)), judged)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = docs.select(F.col(id_col).alias("id"), quality(rules, text_col).alias("found"))
    return found.select(F.col("id").alias(id_col), *[F.col("found")[n].alias(n) for n in names])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows whose text passes the base and every rule; columns as they were."""
    return docs.where(quality(rules, text_col)["kept"])


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The report for DuckDB, over ``documents``."""
    tests = " AND ".join(
        [f"100 * {r.count} >= {r.low} * {r.of}" for r in rules if r.low is not None] + [f"100 * {r.count} <= {r.high} * {r.of}" for r in rules if r.high is not None]
    )
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
places AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM places GROUP BY doc_id),
c AS (SELECT t.doc_id, 1 AS one, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(words, lambda w: suffix(w, '!!'))) AS n_shouts, len(list_intersect(list_distinct(list_transform(words, lambda w: lower(w))), [{stops}])) AS n_stop_words,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len(list_filter(lines, lambda x: prefix(x, '- ') OR prefix(x, '* ') OR prefix(x, '• '))) AS n_bullets, len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS n_ellipses,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {tests} AS kept FROM b
"""
