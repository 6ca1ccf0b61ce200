import random

from pyspark.sql import functions as F

from tidewatch.llm import chat_format

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def brute(a, b):
    a, b = a or [], b or []
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1

    def render(turns):
        out, spans = "", []
        for _, role, text in turns:
            out += f"<|{role or ''}|>\n"
            begin = len(out)
            out += f"{text or ''}<|end|>\n"
            if role == "assistant":
                spans.append((begin, len(out)))
        return out, spans
    (prompt, _), (c, cs), (r, rs) = render(a[:n]), render(a[n:]), render(b[n:])
    return n, prompt, c, r, cs, rs


def test_equals_brute_force(spark):
    rng = random.Random(1)
    talk = lambda: [(i, rng.choice(["user", "assistant", None]), rng.choice(["a", "é\n", "", None, "𝒳 z"])) for i in range(rng.randint(0, 5))]
    rows = []
    for i in range(80):
        a = talk()
        b = a[:rng.randint(0, len(a))] + talk()
        rows.append((i, a, b, "kept"))
    rows += [(100, None, None, None), (101, [], [(0, "assistant", "x")], ""), rows[3], (None, rows[4][1], rows[4][1], "same")]
    pairs = spark.createDataFrame(rows, f"pair long, chosen {TURNS}, rejected {TURNS}, note string")
    for c in ("prompt", "n_prompt_turns", "c", "r", "n", "kept", "chosen_spans", "a.b"):  # clashing names
        pairs = pairs.withColumn(c, F.lit("x"))
    got = chat_format.preference_pairs(pairs).collect()
    assert {"c", "r", "n", "kept", "a.b", "note"} <= set(got[0].asDict()) and len(set(got[0].__fields__)) == len(got[0])
    flat = lambda r: (r["pair"], r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], [tuple(s) for s in r["chosen_spans"]], [tuple(s) for s in r["rejected_spans"]])
    assert sorted(map(str, map(flat, got))) == sorted(str((i, *brute(a, b))) for i, a, b, _ in rows)
    for r in got:
        for text, spans in ((r["chosen"], r["chosen_spans"]), (r["rejected"], r["rejected_spans"])):
            assert all(text[s["begin"]:s["end"]].endswith("<|end|>\n") for s in spans)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "x"), (2, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.conversations(turns).collect()}
    assert got == {1: [(1, "user", "a"), (1, "user", "a"), (2, "user", "b")], 2: [(None, None, None)]}
    assert chat_format.conversations(turns.where("false")).collect() == []


def exchanged(talks):
    """conversation id -> (chosen, rejected) from id -> turns in order."""
    answered = [i for i in sorted(talks) if any(t[1] == "assistant" for t in talks[i])]
    out = {}
    for k, i in enumerate(answered):
        other = [t[2] for t in talks[answered[(k + 1) % len(answered)]] if t[1] == "assistant"]
        n, side = 0, []
        for t in talks[i]:
            if t[1] == "assistant":
                n += 1
                t = (t[0], t[1], other[n - 1]) if n <= len(other) else t
            side.append(t)
        out[i] = (talks[i], side)
    return out if len(answered) > 1 else {}


def test_query_equals_brute_force_with_gaps_and_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    talks = {i * i + 3: [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["same", "b é", "", None, "x" * rng.randint(1, 9)])) for k in range(rng.randint(1, 7))]
             for i in range(60)}
    talks[9999] = [(k, "assistant" if k % 2 else "user", "long " * 200 + str(k)) for k in range(2000)]  # a very long one
    talks[10_000] = [(k, "assistant" if k % 2 else "user", "long " * 200 + str(k % 1999)) for k in range(2000)]
    rows = [(i, *t) for i, turns in talks.items() for t in turns] + [(None, 1, "assistant", "no conversation")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")).withColumn("place", F.lit(1))
    turns.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op2_chat_format(spark, str(tmp_path)).collect()}
    want = exchanged(talks)
    assert set(got) == set(want)
    for i, (a, b) in want.items():
        n, prompt, c, r, cs, rs = brute(a, b)
        spans = [",".join(f"{x}-{y}" for x, y in s) for s in (cs, rs)]
        assert (n, prompt, c, r, *spans) == tuple(got[i])[1:], i
    one = spark.createDataFrame([(1, 1, "assistant", "a"), (2, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat_format.exchanged_answers(one).count() == 0 and chat_format.exchanged_answers(one.where("false")).count() == 0
