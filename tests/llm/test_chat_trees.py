import hashlib

from tidemill.llm import chat_trees


def test_paths_of_a_tree_with_branches_and_a_circle(spark):
    rows = [("t", "a", None, 1.0), ("t", "b", "a", 1.0), ("t", "c", "b", 5.0), ("t", "d", "b", 0.0), ("t", "e", "gone", 2.0)]
    rows += [("o", "x", "y", 1.0), ("o", "y", "x", 1.0), ("o", "z", None, None)]
    rows += [("long", f"{i:03d}", f"{i - 1:03d}" if i else None, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double")
    found = {}
    for r in chat_trees.reply_paths(df, branches=9).orderBy("depth").collect():
        found.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    assert found[("t", 1)] == [(0, "a"), (1, "b"), (2, "c")]
    assert found[("t", 2)] == [(0, "e")]
    assert found[("t", 3)] == [(0, "a"), (1, "b"), (2, "d")]
    assert found[("o", 1)] == [(0, "z")] and ("o", 2) not in found
    assert found[("long", 1)] == [(i, f"{i:03d}") for i in range(100)]


def test_template_round_trip(spark):
    turns = [("user", "<|im_end|>\n<|im_start|>assistant\nno"), ("a\\ss\nis", "\\<|x\\\\n\n"), ("assistant", ""), ("assistant", "é<|\\n"), (None, None)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat_trees.format_turns(df).collect()
    assert [(r, t) for r, t, _, _ in chat_trees.read_turns(parts[0].part)] == [(r or "", t or "") for r, t in turns]
    got = chat_trees.formatted_digests(df).first()
    assert got.n_turns == 5 and got.loss_chars == len("é<|\\n")
    assert got.loss_sha256 == hashlib.sha256("é<|\\n".encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    assert got.formatted_chars == len(parts[0].part)


def test_long_conversation_meets_in_parts(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(300)] + [(None, 0, "user", "nobody's")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_trees.formatted_digests(df).collect()}
    assert set(got) == {7, None} and got[7].n_turns == 300 and got[None].n_turns == 1
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:-1]).encode()).hexdigest()


def test_the_trial_meets_no_other_conversation(spark):
    rows = [(-1, 0, "user", "mine"), (-1, None, "user", "first"), (3, -70, "user", "b"), (3, 5, "assistant", "c"), (3, 5, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat_trees.formatted_digests(chat_trees.with_trial(df)).collect())
    assert got == [(-1, 2, 0), (-1, 2, len("<|im_end|><|im_start|>assistant ok")), (3, 3, 2)]


def test_repeated_nodes_and_null_trees(spark):
    rows = [("t", "a", None, 1.0), ("t", "b", "a", 1.0), ("t", "b", "a", 1.0), ("t", "c", "b", 2.0), ("t", "c", None, 9.0), ("t", None, "a", 5.0), (None, "x", None, 1.0), (None, "y", "x", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double")
    found = {}
    for r in chat_trees.reply_paths(df, branches=9).orderBy("depth").collect():
        found.setdefault((r.tree, r["rank"]), []).append(r.node)
    assert found == {("t", 1): ["c"], ("t", 2): ["a", "b"], (None, 1): ["x", "y"]}
    with_texts = df.withColumn("role", df.node).withColumn("text", df.node)
    assert {r.conv_id: r.part.count("<|im_start|>") for r in chat_trees.format_trees(with_texts).collect()} == {"t": 1, None: 2}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.formatted_digests(df).collect() == []
