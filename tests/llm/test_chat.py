from pvspark.llm import chat, oracle

from tests.llm.common import SF, connect, same

SCHEMA = "conv_id long, turn long, role string, text string, place long, n long, h1 long, kept string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def test_prefixes_go_and_copies_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye")]
    rows += [(3, 5, "user", "hi"), (3, 6, "assistant", "hello"), (3, 9, "user", "bye")]  # other numbers, same turns
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, "user", "hi")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.render(conversations(spark, rows)).collect()}
    assert set(got) == {2, 4} and got[2][:2] == (3, 2) and got[4][:2] == (2, 1)
    assert got[4][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_equals_sql(spark):
    same(chat.render(spark.read.parquet(f"{SF}/conversations.parquet")), connect(), oracle.CHAT)


def test_equals_sql_on_snapshots(spark, tmp_path):
    base = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c % 7} {t} {(c // 3) % 2 if t > 2 else 0}") for c in range(60) for t in range(c % 6 + 1)]
    spark.createDataFrame(base, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    con = connect()
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    out = chat.render(spark.read.parquet(f"{tmp_path}/c.parquet"))
    assert 0 < out.count() < 60
    same(out, con, oracle.CHAT)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "x"), (1, 0, None, None), (1, 0, None, None), (1, 1, "b", "tie"), (1, 1, "a", "tie"), (2, 0, "user", "y" * 300_000)]
    got = {r.conv_id: r for r in chat.render(conversations(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[1].n_turns == 3 and len(got[2].text) > 300_000
    assert got[1].text.startswith("<|im_start|>unknown\n<|im_end|>\n<|im_start|>a\ntie")
    assert chat.render(conversations(spark, rows).filter("false")).count() == 0
