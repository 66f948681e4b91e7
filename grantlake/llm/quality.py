"""Quality rules: a threshold table compiled into one projection.

``RULES`` names ratios of a document's length, symbols, stop words and lines
with the range that passes. ``score`` adds the measures they use and the
verdict; it is one projection without shuffle or user functions, so it costs one
scan at any size.

Defined cases: a null or empty text has no words, so every measure is 0 and it
is rejected for its length; texts of any length are measured whole; rows that
repeat are judged alike; an empty table gives an empty table; input columns with
the names of measures are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import WORD

#: Common words of the languages served (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to in that is it for with as was on be by this are from or an at a "
    "le la les de des et un une du en que qui dans pour par est pas au sur "
    "der die das und ist zu den von mit sich im nicht auf ein eine "
    "el los las del y se por con para una es al lo"
).split()

#: (rule, measure as SQL over the columns that ``score`` adds, least, most); None: open.
RULES = (
    ("words", "n_words", 50, None),
    ("repeats", "100 * n_repeat_words / nullif(n_words, 0)", None, 50),
    ("word_length", "word_chars / nullif(n_words, 0)", 2, 15),
    ("symbols", "n_symbols / nullif(n_words, 0)", None, 0.3),
    ("exclamations", "n_bangs / nullif(n_words, 0)", None, 0.5),
    ("stop_words", "n_stop_words / nullif(n_words, 0)", 0.06, None),
    ("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.3),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_bangs", "n_stop_words")


def verdict(rules=RULES) -> str:
    """The table as one SQL condition; a document without words or lines fails."""
    tests = [f"{m} >= {low}" for _, m, low, _ in rules if low is not None] + [f"{m} <= {high}" for _, m, _, high in rules if high is not None]
    return f"coalesce({' AND '.join(tests)}, false)"  # a ratio to nothing is null


def score(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    has_word = r"[^\\x20\\x09-\\x0D]"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    # Each step refers to the arrays of the one before at least twice, so that
    # they are built once and not again inside a lambda.
    step = docs.withColumn("__text", text).withColumns(
        {
            "__words": F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)),
            "__lines": F.expr(f"filter(split(__text, '\\n', -1), x -> x rlike '{has_word}')"),
            "word_chars": F.length(F.regexp_replace("__text", r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_bangs": F.length(F.regexp_replace("__text", "[^!]+", "")).cast("long"),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.expr("cast(size(__words) as bigint)"),
            "n_stop_words": F.expr(f"cast(size(filter(__words, w -> lower(w) in ({stop}))) as bigint)"),
            "n_lines": F.expr("cast(size(__lines) as bigint)"),
            "n_dup_lines": F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)"),
            "__grams": F.expr(
                "if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))))"
            ),
        }
    )
    step = step.withColumn(
        "__order",
        F.expr("if(size(array_distinct(__grams)) = size(__grams), cast(array() as array<struct<g: bigint, i: int>>), array_sort(transform(__grams, (g, i) -> struct(g, i))))"),
    )
    step = step.withColumn(
        "__at", F.expr("array_sort(transform(filter(__order, (x, k) -> (k > 0 and get(__order, k - 1).g = x.g) or (get(__order, k + 1).g is not null and get(__order, k + 1).g = x.g)), x -> x.i))")
    )
    step = step.withColumn(
        "n_repeat_words",
        F.expr("cast(if(size(__at) = 0, 0, 3 + aggregate(zip_with(slice(__at, 2, size(__at)), slice(__at, 1, size(__at) - 1), (b, a) -> least(3, b - a)), 0, (s, x) -> s + x)) as bigint)"),
    )
    step = step.drop("__text", "__words", "__lines", "__grams", "__order", "__at")
    step = step.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumn("kept", F.expr(f"not base_failed and ({verdict(rules)})"))
    # A filter on a result would be pushed down with all that it is computed from written out again and
    # again, and arrays built anew inside lambdas. It does not pass a projection that is not deterministic.
    return step.withColumns({c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)) for c in (*MEASURES, "base_failed", "kept")})


def keep(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns alone."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(f"`{text_col}`").alias("__raw"))
    return score(whole, rules, "__raw").where("kept").select("__doc.*")
