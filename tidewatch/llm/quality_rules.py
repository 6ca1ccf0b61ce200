"""Quality rules: a table of thresholds, compiled into one projection over counts of a text.

Every measure is a DataFrame expression over a row's own text, so the whole filter is one map: no shuffle, no Python.
A rule is a row of the table: the measure, its least and its greatest allowed value. Another corpus takes another table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.native import let, words

#: Words of a window for repeats inside one text.
WINDOW = 8

# Frequent words of the languages the corpus is written in, by which prose differs from lists and codes.
STOP_WORDS = {
    "en": "a an and are as at be by for from has he in is it of on or that the this to was were which with".split(),
    "de": "auf das dem den der des die ein eine er es ich im in ist mit nicht sich sie und von zu".split(),
    "es": "a al con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au aux ce dans de des du elle en est et il la le les on ou par pas pour que qui un une".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if least <= measure <= most; a bound that is None is open, a measure that is NULL passes."""
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules decide `base_failed`; the others only what is kept of the rest. Percent measures are whole-number products, so bounds are exact.
BASE_RULES = [
    Rule("too_few_words", "n_words", least=20),
    Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", most=0),
]
RULES = [
    Rule("too_many_words", "n_words", most=10_000_000),
    Rule("short_words", "2 * word_chars - 3 * n_words", least=0),
    Rule("long_words", "word_chars - 20 * n_words", most=0),
    Rule("symbols", "10 * n_symbols - n_words", most=0),
    Rule("shouting", "2 * n_marks - n_words", most=0),
    Rule("few_stop_words", "n_stop_words", least=2),
    Rule("repeated_lines", "10 * n_dup_lines - 3 * n_lines", most=0),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines - 3 * n_lines", most=0),
    Rule("bullet_lines", "10 * n_bullet_lines - 9 * n_lines", most=0),
]


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Of an array of words, how many lie in a window of so many words that the array holds twice or more.

    Window hashes tell texts without repeats at once. For the others, windows are sorted by hash; neighbours
    of equal hash are compared word by word, and overlapping repeats count each word once.
    """
    def gram(at: Column) -> Column:
        return F.slice(found, at, window)

    def covered(by_hash: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            other = F.get(by_hash, j)
            return F.coalesce((other["h"] == x["h"]) & (gram(other["at"]) == gram(x["at"])), F.lit(False))
        starts = F.transform(by_hash, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["at"]))
        starts = F.sort_array(F.filter(starts, lambda at: at.isNotNull()))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda acc, at: F.struct(
            (acc["n"] + (at + window - F.greatest(acc["end"], at))).alias("n"), (at + window).alias("end")), lambda acc: acc["n"])

    def counted(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
                .otherwise(let(by_hash, covered)))

    hashes = F.transform(F.sequence(F.lit(1), F.size(found) - (window - 1)), lambda at: F.xxhash64(gram(at)))
    return F.when(F.size(found) <= window, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def measures(text: str | Column) -> Column:
    """One struct with all counts of a text that rules may use."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    stops = sorted({w for some in STOP_WORDS.values() for w in some})

    def counted(parts: Column) -> Column:
        found, lines = parts["words"], parts["lines"]
        has_stop = lambda w: F.lower(F.translate(w, ".,;:!?\"'()", "")).isin(stops)
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            _count(text, "#*$%&|<>").cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(found).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            _count(text, "!?").cast("long").alias("n_marks"),
            F.size(F.filter(found, has_stop)).cast("long").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"))

    with_word = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    return let(F.struct(words(text).alias("words"), with_word.alias("lines")), counted)


def _fails(rule: Rule) -> Column:
    value, broken = F.expr(rule.measure), F.lit(False)
    if rule.least is not None:
        broken = broken | (value < rule.least)
    if rule.most is not None:
        broken = broken | (value > rule.most)
    return F.coalesce(broken, F.lit(False))


def apply_rules(docs: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES, id_col: str = "doc_id",
                text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, all measures, base_failed, kept, failed_rules (names in table order, joined by commas), and with
    `carry` the input row as struct `row`.

    Words are `[^\\x20\\x09-\\x0D]+`; characters are code points; lines are what \\n cuts, those without a word left out. A null, empty or
    blank text has no words and fails the base. Repeated rows are judged each; other columns are ignored, also ones named like a
    measure; an empty table gives no rows. A text is measured whole whatever its length: its words are one array, so a task needs some
    hundred bytes of memory a word of its longest text.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    counted = (docs.select(F.col(f"`{id_col}`").alias("id"), measures(F.col(f"`{text_col}`")).alias("m"), *row)
               .select("id", "m.*", *(["row"] if carry else [])))
    failed = [F.when(_fails(r), F.lit(r.name)) for r in [*base, *rules]]
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | _fails(rule)
    judged = counted.withColumn("base_failed", base_failed).withColumn("failed_rules", F.concat_ws(",", *failed))
    return judged.withColumn("kept", F.col("failed_rules") == "").withColumnRenamed("id", id_col)


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for some in STOP_WORDS.values() for w in some}))

    def fails(rule):
        return " OR ".join([f"{rule.measure} < {rule.least}"] * (rule.least is not None) + [f"{rule.measure} > {rule.most}"] * (rule.most is not None))
    names = ", ".join(f"CASE WHEN {fails(r)} THEN '{r.name}' END" for r in [*BASE_RULES, *RULES])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
by_line AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
of_lines AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines,
    sum(CASE WHEN rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…' THEN n ELSE 0 END)::BIGINT AS n_ellipsis_lines,
    sum(CASE WHEN ltrim(line, ' ')[1] IN ('-', '*', '•') THEN n ELSE 0 END)::BIGINT AS n_bullet_lines FROM by_line GROUP BY doc_id),
grams AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM grams SEMI JOIN twice USING (doc_id, g), range(0, 8) AS r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks,
    len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,;:!?"''()]', '', 'g')) IN ({stops})))::BIGINT AS n_stop_words,
    coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines
  FROM d LEFT JOIN of_lines USING (doc_id) LEFT JOIN hit USING (doc_id))
SELECT *, {" OR ".join(fails(r) for r in BASE_RULES)} AS base_failed, concat_ws(',', {names}) AS failed_rules, concat_ws(',', {names}) = '' AS kept
FROM m"""


ORACLE = _oracle()
