"""Statistics of whole texts as Spark columns, for the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Words in a window that counts as repeated when it is found again.
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Whole numbers with few distinct values each, so that their exact percentiles are cheap.
FEATURES = ["f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_marks"]


def removed(text: Column, pattern: str) -> Column:
    """How many code points of the text match a class of characters."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the COUNTS of each row's whole text; the text itself goes.

    A null text counts as an empty one: all counts are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("__text")).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    starts = F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1))
    rows = rows.withColumn(
        "__windows", F.when(F.size("__words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    )
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    # Most texts repeat no window; only for the others are the windows sorted to find those with equals.
    rows = rows.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    at = F.col("__sorted")
    again = F.filter(at, lambda x, k: (F.get(at, k - 1)["h"] == x["h"]) | F.coalesce(F.get(at, k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("__again", F.sort_array(F.transform(again, lambda x: x["i"])))
    found = F.col("__again")
    covered = F.aggregate(
        found,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return rows.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        removed(F.col("__text"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        removed(F.col("__text"), r"\p{Lu}+").alias("n_upper"),
        removed(F.col("__text"), "[!?]+").alias("n_marks"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    """Adds the FEATURES: the counts in proportion to words, lines or characters, as whole numbers."""

    def share(part: str, whole: str, scale: int) -> Column:
        return F.floor(F.col(part) * scale / F.greatest(F.col(whole), F.lit(1))).cast("long")

    return stats.withColumns(
        {
            "f_words": F.least("n_words", F.lit(1000)),
            "f_word_chars": share("word_chars", "n_words", 10),
            "f_symbols": share("n_symbols", "n_words", 100),
            "f_dup_lines": share("n_dup_lines", "n_lines", 100),
            "f_repeats": share("n_repeat_words", "n_words", 100),
            "f_upper": share("n_upper", "word_chars", 100),
            "f_marks": share("n_marks", "n_words", 100),
        }
    )


def one_label(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One row per id with a 0 or 1 in ``label``; rows of an id that disagree, or others, don't count."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(column).isin(0, 1))
    both = known.groupBy(F.col(id_col).alias("__of")).agg(F.min(column).alias("label"), F.max(column).alias("__max"))
    return both.filter(F.col("label") == F.col("__max")).select("__of", "label")


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The rows (with doc_id) that have a label."""
    found = one_label(labels, column)
    return rows.join(found, rows["doc_id"] == found["__of"]).drop("__of")
