"""Operator 3: quality rules as one Spark projection.

A table of rules (measure, least, most) is compiled into a single boolean column over
measures of the text: lengths, symbols, stop words, repeated lines and repeated
three-word windows.  All of it is built from Spark's own functions; nothing is
shuffled and no row depends on another.

A null text has no words.  A text without words has ratios of 0 and fails the base
rule.  Windows are compared by a 64-bit hash of their three words within one text.
Repeated rows are measured each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import documents, fresh

#: Characters that part words, and those counted as symbols.
SPACE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
#: Common function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is that it for was on are as with be at by this from or an have not
der die das und den von zu mit ist im des ein eine nicht auf für dem sich auch
le la les de des et un une du en est que pour dans qui sur au pas plus par
el los las del y por con una su para como más al se lo
""".split()


@dataclass(frozen=True)
class Rule:
    """A measure's permitted range, both ends included; None: no limit."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("mean_word_chars", 2, 15),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three found twice or more."""

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            grow = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
            return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), grow, lambda acc: acc["n"])

        neighbours = _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.coalesce(neighbours, F.lit(0)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, of_windows)

    return _let(words, of_words)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows with the measures added; existing columns of those names are replaced, all others stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, own, bullets, dots, n_lines = fresh(df, "w", "own", "bullets", "dots", "n_lines_")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    base = df.withColumns({w: _words(t), own: lines})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    without = lambda characters: F.char_length(F.translate(t, characters, ""))
    counted = base.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": without(_SPACES).cast("long"),
            "n_symbols": (F.char_length(t) - without(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(own) - F.size(F.array_distinct(own))).cast("long"),
            "n_repeat_words": _repeated(F.col(w)).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long"),
            bullets: F.size(F.filter(own, lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))),
            dots: F.size(F.filter(own, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))),
            n_lines: F.size(own),
        }
    ).drop(w, own)
    shares = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_word_share": ("n_stop_words", "n_words"),
        "dup_line_share": ("n_dup_lines", n_lines),
        "bullet_line_share": (bullets, n_lines),
        "ellipsis_line_share": (dots, n_lines),
    }
    return counted.withColumns({name: share(*parts) for name, parts in shares.items()}).drop(bullets, dots, n_lines)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where all rules hold."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.measure) >= F.lit(r.least))
        if r.most is not None:
            out = out & (F.col(r.measure) <= F.lit(r.most))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    m = measure(documents(spark, sf_dir, "doc_id", "text")).withColumn("base_failed", base_failed())
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict()).alias("kept"))


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*{chr(0x2022)}]'))) AS bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|{chr(0x2026)})[\x20\x09-\x0D]*$'))) AS dots
      FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / n_words >= 2 AND word_chars / n_words <= 15 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9 AND dots / n_lines <= 0.3 AS kept
FROM v"""


ORACLE = _oracle()
