"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every metric is an expression over the text; a rule bounds one metric from below or above, and the verdict is that all hold. Nothing is
shuffled. Words are the runs of characters other than ASCII white space.

Defined results: a null or empty text has no words, so it fails; a text without words has ratio 0 in every metric; a value equal to a
bound passes; very long texts are judged whole; rows that repeat each other are each judged; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = ("\t", "\n", "\x0b", "\x0c", "\r", " ")
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")
#: Frequent short words of the languages that the rules are meant for.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this have from at or an "
    "der die das und ist nicht mit den von zu auf für ein eine im dem des sich auch "
    "le la les de des et un une du en est que qui dans pour pas sur au "
    "el los las y que en un una por con del se su para es no lo"
).split()


@dataclass(frozen=True)
class Rule:
    metric: str
    least: float | None = None
    most: float | None = None


#: The thresholds: lengths, symbols, stop words and lines.
RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=1.5, most=20.0),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_ratio", least=0.01),
    Rule("dup_line_ratio", most=0.4),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)
RUN = 5


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, chars: tuple[str, ...]) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit("".join(SPACES)))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column) -> Column:
    """Words inside windows of RUN words that occur twice or more, by 64-bit hashes of the windows."""

    def spans(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                same = lambda k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
                return F.when(same(i + 1) | (F.when(i > 0, same(i - 1)).otherwise(F.lit(False))), x["i"])

            return F.sort_array(F.filter(F.transform(rows, again), lambda e: e.isNotNull()))

        def covered(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(-RUN).alias("last"), F.lit(0).alias("n")), lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(s - a["last"], F.lit(RUN))).alias("n")), lambda a: a["n"])

        return _let(_let(ordered, starts), covered)

    def hashed(w: Column) -> Column:
        last = F.size(w) - RUN
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(RUN))))

    some = _let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spans(h)))
    return F.when(F.size(words) <= RUN, F.lit(0)).otherwise(some).cast("long")


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the metrics."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", whole.alias("_t"), words_of(whole).alias("_w"), F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_words, n_lines = F.size("_w"), F.size("_l")
    counted = base.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        ratio(F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))), n_words).alias("stop_word_ratio"),
        n_lines.alias("_n_lines"),
        ratio(F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]"))), n_lines).alias("bullet_line_ratio"),
        ratio(F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), n_lines).alias("ellipsis_line_ratio"),
    )
    return counted.select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
    ).drop("_n_lines")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    held = F.lit(True)
    for r in rules:
        if r.least is not None:
            held = held & (F.col(r.metric) >= r.least)
        if r.most is not None:
            held = held & (F.col(r.metric) <= r.most)
    return held


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The metrics, base_failed and kept of every row."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return metrics(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, range(1, len(ws) - 3) r(i)),
rep AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(gap, 5)))::BIGINT AS n FROM rep GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS nl,
         len(list_filter(ws, lambda x: list_contains(STOPS, lower(x)))) AS stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots
  FROM w LEFT JOIN cov c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words::DOUBLE >= 1.5 AND word_chars / n_words::DOUBLE <= 20.0 AND n_symbols / n_words::DOUBLE <= 0.3
       AND stops / n_words::DOUBLE >= 0.01 AND n_dup_lines / nl::DOUBLE <= 0.4 AND bullets / nl::DOUBLE <= 0.9 AND dots / nl::DOUBLE <= 0.3 AS kept
FROM f
""".replace("STOPS", "[" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "]")
