"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each text gets its counts in higher-order functions, without a shuffle. Mergeable quantile
sketches (Spark's approx_percentile, which combines partial sketches) of four ratios are
taken by language and source, by language, and of all texts that pass the base rules, in one
aggregation. Quantiles are pooled by counts: those of a source count as its texts, against a
fixed number for its language's, and a language's likewise against those of all. A text is
kept if every ratio lies within its group's fences: a multiple of the quartiles' distance
beyond them, and never within the outermost hundredth. The fences are joined to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # per cent of the words
#: Ratios: name, expression, and whether low values are rejected too.
RATIOS = (
    ("word_length", "word_chars / n_words", True),
    ("symbols", "n_symbols / word_chars", False),
    ("dup_lines", "n_dup_lines / n_words", False),
    ("repeats", "n_repeat_words / n_words", False),
)
#: Quantiles of the sketches: the quartiles, and the outermost hundredth on each side.
QUANTILES = (0.01, 0.25, 0.75, 0.99)
FENCE = 3.0
ACCURACY = 10_000
#: Texts that the quantiles of the level above count as.
POOLED_TEXTS = 100


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def of_windows(hashed: Column) -> Column:
        # Windows by hash and place; those with an equal neighbour are repeated.
        placed = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            marked = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        covered = _let(_let(placed, repeated), lambda p: F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))))
        total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0).cast("long")).otherwise(total)

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, of_windows)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    bare = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    got = given.select(
        "doc_id", "lang", "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    got = got.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return got.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def fences(counted: DataFrame, pooled: int = POOLED_TEXTS) -> DataFrame:
    """lang_p, source_p and the bounds of each ratio, for every pair of language and source; nulls are a value of their own."""
    ratios = counted.where(~F.col("base_failed")).select("lang", "source", *(F.expr(e).alias(n) for n, e, _ in RATIOS))
    sketch = [F.count(F.lit(1)).alias("n"), *(F.percentile_approx(n, list(QUANTILES), ACCURACY).alias(n) for n, *_ in RATIOS)]
    levels = written(ratios.rollup("lang", "source").agg(F.grouping_id().alias("level"), *sketch), "sketches")
    named = lambda level, by, keys: levels.where(F.col("level") == level).select(*(F.col(k).alias(f"{k}_{by}") for k in keys), F.struct("n", *(n for n, *_ in RATIOS)).alias(by))
    # A row for each pair meets its language's row and the one of all texts.
    pairs = named(0, "p", ("lang", "source")).join(named(1, "l", ("lang",)), F.col("lang_p").eqNullSafe(F.col("lang_l"))).crossJoin(F.broadcast(named(3, "a", ())))
    bounds = []
    for name, _, both in RATIOS:
        q = []
        for i in range(len(QUANTILES)):
            mixed = F.col("a")[name][i]
            for level in ("l", "p"):
                mixed = (F.col(level)["n"] * F.col(level)[name][i] + pooled * mixed) / (F.col(level)["n"] + pooled)
            q.append(mixed)
        room = FENCE * (q[2] - q[1])
        bounds += [F.greatest(q[2] + room, q[3]).alias(f"{name}_high"), (F.least(q[1] - room, q[0]) if both else F.lit(None).cast("double")).alias(f"{name}_low")]
    return pairs.select("lang_p", "source_p", *bounds)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every text.

    Null and empty texts have counts of 0 and fail the base rules. Null languages and sources
    are groups of their own. Null ids and repeated rows are kept. No rows: no rows. Other
    columns are left out, whatever their names.
    """
    counted = written(counts(docs), "quality")
    joined = counted.join(fences(counted), F.col("lang").eqNullSafe(F.col("lang_p")) & F.col("source").eqNullSafe(F.col("source_p")), "left")
    inside = F.lit(True)
    for name, expression, both in RATIOS:
        value = F.expr(expression.replace("/", ",").join(("try_divide(", ")")))
        inside = inside & (value <= F.col(f"{name}_high"))
        if both:
            inside = inside & (value >= F.col(f"{name}_low"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql_sketch(by: str) -> str:
    pick = ", ".join(f"list(r_{n} ORDER BY r_{n})[greatest(1, ceil({p} * count(*)))::BIGINT] AS {n}_{k}" for n, *_ in RATIOS for k, p in enumerate(QUANTILES))
    return f"SELECT {by + ',' if by else ''} count(*) AS n, {pick} FROM ratios {'GROUP BY ' + by if by else ''}"


def _sql_inside() -> str:
    out = []
    for n, expression, both in RATIOS:
        q = []
        for k in range(len(QUANTILES)):
            lang = f"((l.n * l.{n}_{k} + {POOLED_TEXTS} * a.{n}_{k}) / (l.n + {POOLED_TEXTS}))"
            q.append(f"((p.n * p.{n}_{k} + {POOLED_TEXTS} * {lang}) / (p.n + {POOLED_TEXTS}))")
        room = f"({FENCE} * ({q[2]} - {q[1]}))"
        out.append(f"{expression} <= greatest({q[2]} + {room}, {q[3]})")
        if both:
            out.append(f"{expression} >= least({q[1]} - {room}, {q[0]})")
    return " AND ".join(out)


OP5_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
three AS (SELECT r, i, word, lead(word) OVER a AS w2, lead(word, 2) OVER a AS w3 FROM words WINDOW a AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) > 1 AS twice FROM three),
cover AS (SELECT r, twice OR coalesce(lag(twice) OVER a, false) OR coalesce(lag(twice, 2) OVER a, false) AS c FROM again WINDOW a AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM cover GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT docs.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats ON docs.r = repeats.r LEFT JOIN dups ON docs.r = dups.r),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted),
ratios AS (SELECT lang, source, {", ".join(f"({e})::DOUBLE AS r_{n}" for n, e, *_ in RATIOS)} FROM based WHERE NOT base_failed),
p AS ({_sql_sketch("lang, source")}), l AS ({_sql_sketch("lang")}), a AS ({_sql_sketch("")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_sql_inside()} END AS kept
FROM based b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""
