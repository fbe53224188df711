"""Quality rules: a threshold table compiled into one projection, built-in functions only.

Nulls count as empty texts.  An empty or short text fails the base rules; it is never an
error.  Repeated rows are judged one by one, extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, WORD, packed, unpacked, whole_text, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by from this an at or "
    "le la les de des du et un une en que qui est pour dans pas par sur au ce "
    "der die das und von mit ist ein eine den dem zu im auf für nicht auch sich "
    "el los las una por con del es se no su al lo para como más"
).split()

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()"


@dataclass(frozen=True)
class Rule:
    """A ratio of two signals must lie between the bounds; an empty base passes."""

    name: str
    part: str
    base: str
    least: float = float("-inf")
    most: float = float("inf")


# Share of words, characters and lines; wide enough for clean prose in four languages.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.2),
    Rule("marks_per_word", "n_marks", "n_words", most=0.3),
    Rule("upper_share", "n_upper", "word_chars", most=0.3),
    Rule("stop_word_share", "n_stop", "n_words", least=0.04),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", most=0.4),
    Rule("dangling_line_share", "n_dangling", "n_lines", most=0.4),
    Rule("bullet_line_share", "n_bullets", "n_lines", most=0.9),
)

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_marks",
    "n_upper",
    "n_stop",
    "n_dangling",
    "n_bullets",
)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and the counts the rules are made of.

    Words in repeated three-word windows are found by sorting the windows of a text, so the
    work per text is n log n and no row leaves its task.
    """
    rows = packed(docs).withColumn("t", whole_text(f"row.{text}"))
    split = rows.withColumns({"w": words(F.col("t")), "lines": F.split(F.col("t"), "\n", -1)})
    counted = split.withColumns(
        {
            "lines": F.filter("lines", lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0),
            "n_words": F.size("w").cast("long"),
            "word_chars": _without(F.col("t"), SPACES).cast("long"),
            "n_symbols": (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long"),
            "n_marks": (F.length("t") - _without(F.col("t"), "!")).cast("long"),
            "n_upper": (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).cast("long"),
            "n_stop": F.size(
                F.filter(
                    "w",
                    lambda x: F.lower(F.rtrim(x, F.lit(PUNCTUATION))).isin(STOP_WORDS),
                )
            ).cast("long"),
            # Hashes of the windows tell the many texts without a repeated one cheaply.
            "h": F.when(
                F.size("w") > 3,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))),
                    lambda i: F.xxhash64(_at("w", i), _at("w", i + 1), _at("w", i + 2)),
                ),
            ),
        }
    )
    # Windows sorted by hash, then by their words: equal ones stand side by side.
    sorted_windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))),
            lambda i: F.struct(
                F.xxhash64(_at("w", i), _at("w", i + 1), _at("w", i + 2)).alias("h"),
                F.concat_ws(" ", _at("w", i), _at("w", i + 1), _at("w", i + 2)).alias("g"),
                i.alias("i"),
            ),
        )
    )
    counted = counted.withColumns(
        {
            "s": F.when(F.size(F.array_distinct("h")) < F.size("h"), sorted_windows),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_dangling": F.size(
                F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))
            ).cast("long"),
            "n_bullets": F.size(
                F.filter("lines", lambda x: x.startswith("- ") | x.startswith("•"))
            ).cast("long"),
        }
    )

    def same(i: Column, j: Column) -> Column:
        a, b = _at("s", i), _at("s", j)
        return F.coalesce(
            (a.getField("h") == b.getField("h")) & (a.getField("g") == b.getField("g")),
            F.lit(False),
        )

    indexes = F.sequence(F.lit(0), F.size("s") - 1)
    counted = counted.withColumn(
        "p",
        F.when(
            F.col("s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        indexes, lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0))))
                    ),
                    lambda k: _at("s", k).getField("i"),
                )
            ),
        ),
    )
    # A window covers three words, less what the next repeated window covers as well.
    covered = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.size("p") - 1),
            lambda k: F.coalesce(F.least(F.lit(3), _at("p", k + 1) - _at("p", k)), F.lit(3)),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    counted = counted.withColumn(
        "n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(0).cast("long")
    )
    return counted.select("row", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """All rules as one boolean expression over the counts."""
    result = F.lit(True)
    for rule in rules:
        part, base = F.col(rule.part).cast("double"), F.col(rule.base)
        if rule.least != float("-inf"):
            result = result & (part >= base * F.lit(rule.least))
        if rule.most != float("inf"):
            result = result & (part <= base * F.lit(rule.most))
    return result


def judged(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept``."""
    counted = signals(docs).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    # The row number keeps the filter above the projections; pushed below them, it would
    # work out the arrays again inside every expression that uses them.
    numbered = judged(docs, rules).withColumn("n", F.monotonically_increasing_id())
    return unpacked(numbered.where(F.col("kept") & (F.col("n") >= 0)), docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    bounds = []
    if rule.least != float("-inf"):
        bounds.append(f"{rule.part}::DOUBLE >= {rule.base} * {rule.least}::DOUBLE")
    if rule.most != float("inf"):
        bounds.append(f"{rule.part}::DOUBLE <= {rule.base} * {rule.most}::DOUBLE")
    return " AND ".join(bounds)


def counts_sql(source: str = "documents") -> str:
    """DuckDB: the counts per row of ``source``, with its columns; ids must be unique."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    marks = PUNCTUATION.replace("'", "''")
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
SELECT b.*, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(r.n_repeat_words, 0) > 50 * n_words) AS base_failed
FROM (
  SELECT *, len(w)::BIGINT AS n_words,
    length(translate(t, {blank}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (length(t) - length(translate(t, '!', '')))::BIGINT AS n_marks,
    (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::BIGINT AS n_upper,
    len(list_filter(w, lambda x: lower(rtrim(x, '{marks}')) IN ({stops})))::BIGINT AS n_stop,
    len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230))))::BIGINT
      AS n_dangling,
    len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, chr(8226))))::BIGINT
      AS n_bullets
  FROM (SELECT *, regexp_extract_all(t, '{WORD}') AS w,
          list_filter(string_split(t, chr(10)),
            lambda x: length(translate(x, {blank}, '')) > 0) AS l
        FROM (SELECT *, coalesce(text, '') AS t FROM {source}))
) b
LEFT JOIN (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
    FROM (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
                  FROM {source}))
    )
  ), (SELECT unnest(range(0, 3)) AS k)
  WHERE n > 1 GROUP BY doc_id
) r ON r.doc_id IS NOT DISTINCT FROM b.doc_id"""


def kept_sql(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    return "NOT base_failed AND " + " AND ".join(_sql_rule(r) for r in rules)


def oracle() -> str:
    return f"""
SELECT doc_id, {", ".join(COUNTS)}, base_failed, ({kept_sql()}) AS kept
FROM ({counts_sql()})"""
