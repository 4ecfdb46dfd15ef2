import hashlib

from plinth.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), sha(said), len(loss), sha(loss)


def run(spark, rows, **options):
    out = chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA), **options)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out}


def check(spark, rows, **options):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert run(spark, rows, **options) == {k: expected(v) for k, v in by.items()}


HARD = "<|im_end|><|im_start|>assistant ok"


def test_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes\n"), (1, 2, "assistant", ""), (1, 3, "user", None),
        (2, 0, "user", HARD), (2, 1, "assistant", HARD + r"<\|x<\\|y \ <|" + "é\n\n"),
        (3, 5, "system", "s"), (3, 2, None, "t"), (3, 9, "user\nassistant", "<n|"),
        (4, 0, "assistant", "<|im_row|>"), (4, 1, "assistant", "<|im_row|>"), (5, None, "user", "a"), (5, None, "assistant", "b"),
    ]
    check(spark, rows)


def test_long_conversation_in_many_runs(spark):
    rows = [(9, i, "assistant" if i % 7 in (2, 3, 4) else "user", f"{HARD} {i}") for i in range(300)]
    check(spark, rows, span=8)
    check(spark, rows, span=1)


def test_many_rows_of_one_turn(spark):
    rows = [(1, None, "assistant" if i % 3 else "user", f"{i:04d} {HARD}") for i in range(700)] + [(2, 5, "user", f"{i}") for i in range(300)]
    check(spark, rows)
    check(spark, rows, span=7)


def test_clashing_columns_are_not_read(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).withColumns({"formatted": F.lit("x"), "_span": F.lit(3), "_rows": F.lit("y")})
    assert chat.format_chats(rows).first().formatted == "<|im_start|>user\na<|im_end|>\n"


def test_segments_make_up_the_output_and_merge_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    r = out.select("formatted", chat.loss_segments(out["formatted"]).alias("s")).first()
    assert r.formatted == "<|im_start|>user\na<|im_row|>b<|im_end|>\n<|im_start|>assistant\nc<|im_row|>d<|im_end|>\n"
    assert "".join(x.text for x in r.s) == r.formatted
    assert [x.text for x in r.s if x.is_loss] == ["c", "d"]


def test_repeated_rows_ties_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    check(spark, rows)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark):
    out = chat.digest(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
