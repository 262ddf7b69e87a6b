"""Operator 6: quality rules. A table of thresholds becomes one Spark projection; no user functions run.

The counts of a text come from array functions on its own words, so nothing is shuffled and no text meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x09-\\x0D\\x20]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this an or at from not have has "
    "le la les de des du et en un une que qui dans pour par sur est pas au aux ce il elle avec "
    "der die das und zu den von mit ist dem nicht ein eine im auf für sich als auch es an "
    "el los las y del se su por con para al lo como más no una"
).split()

#: (ratio, least, most); None: no bound. All must hold for a text to be kept.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.2),
    ("stop_word_ratio", 0.03, None),
    ("repeat_line_ratio", None, 0.5),
    ("words_per_line", 2.0, None),
)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns qr_words, qr_lines and the counts n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        "qr_text": t,
        "qr_words": F.array_remove(F.split(t, WORD_GAP), ""),
        "qr_lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0),
    })
    d = d.withColumn("n_words", F.size("qr_words").cast("long"))
    d = d.withColumn(
        "qr_grams",
        F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 2), lambda i: F.xxhash64(
            F.element_at("qr_words", i), F.element_at("qr_words", i + 1), F.element_at("qr_words", i + 2)))),
    )
    # Only a text with a repeated window has its windows sorted.
    twice = F.size(F.array_distinct("qr_grams")) < F.size("qr_grams")
    d = d.withColumn("qr_sorted", F.when(twice, F.sort_array(F.transform("qr_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    d = d.withColumn("qr_same", F.zip_with("qr_sorted", F.slice("qr_sorted", 2, F.size("qr_sorted")), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))))
    at = F.filter("qr_sorted", lambda x, i: F.get("qr_same", i) | F.coalesce(F.get("qr_same", i - 1), F.lit(False)))
    d = d.withColumn("qr_at", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("qr_at", F.slice("qr_at", 2, F.size("qr_at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return d.withColumns({
        "word_chars": F.length(F.array_join("qr_words", "")).cast("long"),
        "n_symbols": (F.length("qr_text") - F.length(F.translate("qr_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("qr_lines").cast("long"),
        "n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": F.size(F.filter("qr_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
    }).drop("qr_text", "qr_words", "qr_lines", "qr_grams", "qr_sorted", "qr_same", "qr_at")


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one condition on the counts of base_counts()."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratio = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "repeat_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    held = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            held = held & (ratio[name] >= least)
        if most is not None:
            held = held & (ratio[name] <= most)
    return held


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = 50, repeat_percent: int = 50, columns=("doc_id",)) -> DataFrame:
    """columns of docs, the counts of base_counts(), base_failed and kept, a row for each row of docs.

    Null and empty texts have no words, so base_failed holds and they aren't kept. Repeated rows each have a result.
    Further columns are ignored, whatever their names.
    """
    d = base_counts(docs.select(*columns, "text"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
    return d.select(*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = {
        "mean_word_chars": "word_chars / w", "symbols_per_word": "n_symbols / w", "stop_word_ratio": "n_stop_words / w",
        "repeat_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "words_per_line": "n_words / greatest(n_lines, 1)",
    }
    rules = [f"{ratio[k]} {op} {v}" for k, lo, hi in THRESHOLDS for op, v in ((">=", lo), ("<=", hi)) if v is not None]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
d AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM d GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS w FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
  NOT base_failed AND {" AND ".join(rules)} AS kept FROM f"""
