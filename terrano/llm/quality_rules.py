"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

RULES holds (measure, lowest, highest) over per-document measures; compile_rules() turns the
table into one boolean expression.  The measures are lengths and word, symbol, stop-word and
line ratios.  Base counts follow the contract of op8.

Repeated five-word windows are found by hashing each window from its five words and looking
for equal neighbours in the sorted hashes; texts whose window hashes are all distinct, nearly
all of them, stop at that test.  Rows never move: the plan is a scan and projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_to_string

WORD = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Frequent words of four languages; a text of hardly anything else says nothing.
STOP_WORDS = sorted(set("""
the of and to in a is that for it on with as was at by be this are or
der die und das den von zu mit ist des im dem nicht ein eine auf für als sich auch
de la le les et des un une du que est pour en dans qui sur pas au par
el los las del y en que un una por con para es se lo no su al
""".split()))
#: (measure, lowest, highest); None: no bound.  A document passes if every measure lies within its bounds.
#: The bounds lie well outside what prose shows, so that clean text stays; as the stop words are those of
#: four languages only, a text without any of them passes.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word", 2.0, 30.0),
    ("symbol_ratio", None, 0.30),
    ("stop_ratio", None, 0.95),
    ("letter_ratio", 0.60, None),
    ("dup_line_ratio", None, 0.30),
    ("repeat_ratio", None, 0.20),
    ("upper_ratio", None, 0.50),
]


def compile_rules(rules: list[tuple[str, float | None, float | None]]) -> Column:
    out = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            out = out & (F.col(name) >= F.lit(low))
        if high is not None:
            out = out & (F.col(name) <= F.lit(high))
    return out


def without(c: Column, pattern: str) -> Column:
    """How many characters of c the pattern's matches cover."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every measure.  Null text is empty; a text without words has zero for each ratio."""
    t = F.col("t")
    w = docs.select(F.col(id_col).alias("doc_id"), empty_to_string(text_col).alias("t")).select(
        "doc_id", "t",
        F.filter(F.split(t, WORD), lambda x: x != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("w")
    w = w.select(
        "doc_id", "t", "lines", F.size("w").cast("long").alias("n_words"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(WINDOW)]))).alias("h"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
    )
    several = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    w = w.withColumn("s", F.when(several, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    hit = F.filter("s", lambda x, j: (F.get(F.col("s"), j - 1)["x"] == x["x"]) | F.coalesce(F.get(F.col("s"), j + 1)["x"] == x["x"], F.lit(False)))
    w = w.withColumn("starts", F.sort_array(F.transform(hit, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    w = w.select(
        "doc_id", "n_words", "n_stop",
        (F.length("t").cast("long") - without(t, WORD)).alias("word_chars"),
        without(t, "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        without(t, r"\p{L}+").alias("n_letters"),
        without(t, r"\p{Lu}+").alias("n_upper"),
    )
    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return w.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word"), ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"), ratio("n_letters", "word_chars").alias("letter_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_upper", "n_letters").alias("upper_ratio"),
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row with the base counts, base_failed and kept.

    Null and empty texts have zero counts and fail.  Repeated rows and ids are judged each on
    its own; columns other than id and text are not looked at, whatever their names.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    bounds = " AND ".join(
        x for name, low, high in RULES
        for x in ([f"{name} >= {low}"] * (low is not None) + [f"{name} <= {high}"] * (high is not None)))
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, range(0, 5) s(j) WHERE c > 1 GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop,
    length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov USING (r)),
q AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
    coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_letters / nullif(word_chars, 0), 0) AS letter_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
    coalesce(n_upper / nullif(n_letters, 0), 0) AS upper_ratio FROM m),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept FROM b
"""


SQL = _sql()
