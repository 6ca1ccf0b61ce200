import re

import pytest
from pyspark.sql import Row

from tidewatch.llm import quality_rules
from tidewatch.llm.quality_rules import Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """Counts of one text, word by word."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    lines = [line for line in text.split("\n") if WORD.search(line)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=sum(c in "#*$%&|<>" for c in text),
                n_dup_lines=sum(line in lines[:i] for i, line in enumerate(lines)), n_repeat_words=len(hit))


PROSE = "It was the best of times and on a day like that we met in the old town by the river with some bread"
TEXTS = [None, "", " \t\n\r ", "one", PROSE, PROSE + "\n" + PROSE, "a b " * 40, "\n".join(["same line"] * 9 + ["other"]),
         "x " * 7, "x " * 8, "x " * 9, "ä𝄞 #$% é|ß <b>", "a\x0bb\x0cc\rd\te", "A b c d e f g h . A b c d e f g h",
         "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0", "word joined  wide", "...\nwait...\nso…  \n- a\n* b\n•c"]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for row in quality_rules.apply_rules(docs).collect():
        want = plain(TEXTS[row.doc_id])
        assert {k: row[k] for k in want} == want, TEXTS[row.doc_id]
        assert row.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (row.base_failed and row.kept)


def test_prose_stays_and_reasons_are_named(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, " ".join("q%d$$" % i for i in range(30))), (3, PROSE.replace(" ", "!! "))], "doc_id long, text string")
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert out[1].kept and out[1].failed_rules == ""
    assert (out[2].failed_rules, out[3].failed_rules) == ("symbols,few_stop_words", "shouting") and not out[2].kept and not out[3].kept


def test_very_long_text_is_measured_whole(spark):
    tail = " ".join(f"w{i}" for i in range(120_000))
    text = PROSE + " " + tail + " " + PROSE
    row = quality_rules.apply_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n = len(PROSE.split())
    assert (row.n_words, row.n_repeat_words) == (120_000 + 2 * n, 2 * n)


def test_other_tables_repeated_rows_and_clashing_columns(spark):
    rows = [Row(doc_id=None, text=PROSE, kept="x", n_words=7, m="y", row=1, **{"a.b": 2})] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, m string, row int, `a.b` int")
    out = quality_rules.apply_rules(docs, carry=True).collect()
    assert len(out) == 3 and all(r.kept is True and r.doc_id is None and r.row["a.b"] == 2 and r.row["kept"] == "x" for r in out)
    strict = quality_rules.apply_rules(docs, rules=[Rule("long", "n_words", most=5), Rule("open", "n_lines")]).first()
    assert strict.failed_rules == "long" and not strict.base_failed


def test_empty_table(spark):
    out = quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and dict(out.dtypes)["base_failed"] == "boolean"


@pytest.mark.parametrize("bounds,fails", [((3, None), False), ((4, None), True), ((None, 3), False), ((None, 2), True), ((None, None), False)])
def test_bounds_are_inclusive(spark, bounds, fails):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert (quality_rules.apply_rules(docs, [], [Rule("r", "n_words", *bounds)]).first().failed_rules == "r") == fails
