"""Chat formatting of reply trees.

Replies form trees.  Joins of the reply table with itself double the reach of
every reply's link towards its root, and a second round of joins with the links
found spells out the root-to-leaf path of each chosen leaf; n levels take about
log2(n) joins.  Branches are ranked by score, and each chosen path becomes one
conversation in a template whose control strings cannot occur inside a text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import as_bytes, cut, pa_schema

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Turns that are joined into one text before the parts of a conversation meet.
BLOCK = 64


# ---- paths --------------------------------------------------------------------------------------


def reply_paths(replies: DataFrame, branches: int = 1, most: int = 40) -> DataFrame:
    """Paths from roots to the best leaves of (tree, node, parent, score).

    Returns (tree, rank, leaf, depth, node): rank 1 is the branch with the
    largest mean score (ties: smaller leaf); depth counts from the root's 0.
    Of rows that repeat a node of a tree, one counts (see ``once``).  Trees may
    be null.  A parent that is null or missing makes a root; null scores count
    0; replies whose ancestors run in a circle have no root and are on no path.
    ``branches`` bounds the report, not the search.  Raises beyond 2^most levels.
    """
    nodes = once(replies.select("tree", "node", "parent", "score"))
    nodes = nodes.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    have = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.join(have, nodes.tree.eqNullSafe(have.t) & (nodes.parent == have.p), "left")
    state = cut(linked.select("tree", "node", F.col("p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")))
    links, reach, active, left = [], state.where("up is null"), state.where("up is not null"), None
    for _ in range(most):
        before, left = left, active.count()
        if not left or left == before:
            break  # a round that ends no reply's way to the root: what is left only circles
        links.append(active.select("tree", "node", "up"))
        above = reach.union(active).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("length").alias("length2"))
        further = cut(
            active.join(above, active.tree.eqNullSafe(above.t) & (active.up == above.n)).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("length") + F.col("length2")).alias("length")
            )
        )
        reach, active = reach.union(further.where("up is null")), further.where("up is not null")
    else:
        raise RuntimeError(f"a chain of replies has over 2^{most} levels")
    inner = state.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = reach.join(inner, reach.tree.eqNullSafe(inner.t) & (reach.node == inner.n), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = chosen.select("tree", "rank", F.col("node").alias("leaf"), "node", (F.col("length") - 1).alias("depth"))
    for k, link in enumerate(links):
        far = link.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(far, paths.tree.eqNullSafe(far.t) & (paths.node == far.n)).select("tree", "rank", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = cut(paths.union(more))
    return paths.select("tree", "rank", "leaf", "depth", "node")


def once(replies: DataFrame) -> DataFrame:
    """One row for each (tree, node): of rows that repeat one, the least by the other columns; null nodes are none."""
    rest = [c for c in replies.columns if c not in ("tree", "node")]
    return replies.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("r")).select("tree", "node", *(F.col(f"r.{c}").alias(c) for c in rest))


# ---- template -----------------------------------------------------------------------------------


def escaped(column):
    """Text in which no control string can occur: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def turn_text(role, text):
    """One turn in the template; a newline in a role is escaped too."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn; begin and end are the text's place in ``formatted``."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not in the template")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in order of turn to (conv_id, block, part): the template in parts of BLOCK turns.

    The parts of a conversation, in order of block, concatenate to its text.
    """
    lines = turns.select("conv_id", (F.col("turn") / BLOCK).cast("long").alias("block"), "turn", turn_text(F.col("role"), F.col("text")).alias("line"))
    parts = lines.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return parts.select("conv_id", "block", F.array_join(F.col("l.line"), "").alias("part"))


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted parts alone.

    A conversation is read as a stream of sorted parts, so one with very many
    turns needs the memory of one part.  The loss mask covers assistant texts.
    """
    kind = dict(parts.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_spans long"
    names = pa_schema(parts.sparkSession, schema)

    def run(batches):
        now, state, out = None, None, []

        def close():
            turns, whole, n, loss, masked, chars, spans = state
            out.append((now, turns, whole.hexdigest(), n, loss.hexdigest(), chars, spans))

        for batch in batches:
            for conv_id, part in zip(batch.column("conv_id").to_pylist(), as_bytes(batch.column("part"))):
                if state is None or conv_id != now:
                    if state is not None:
                        close()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), None, 0, 0]
                formatted = part.decode()
                for role, text, begin, end in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == TRAINED_ROLE:
                        shown = unescape(formatted[begin:end])  # what lies under the mask
                        state[2] += len(shown)
                        state[3].update(shown.encode())
                        state[6] += 1
                state[5] += len(formatted)
            if len(out) > 5000:
                yield batch_of(out)
                out.clear()
        if state is not None:
            close()
        if out:
            yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), names)], schema=names)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(run, schema)


def as_replies(conversations: DataFrame) -> DataFrame:
    """Flat conversations as reply chains: (tree, node, parent, score, role, text).

    ``tree`` is (conv_id, trial), trial null where ``conversations`` has no such
    column; a null conv_id is a conversation too.  Rows of a conversation are
    ordered by turn (null first), then role and text, so repeated turns stay,
    next to each other.  They are numbered block by block of BLOCK turns, from
    the sums of the blocks before, so no task sorts a whole conversation.
    """
    trial = F.col("trial") if "trial" in conversations.columns else F.lit(None).cast("int")
    rows = conversations.select(F.struct("conv_id", trial.alias("trial")).alias("tree"), "turn", "role", "text").withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy("tree").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("tree", "block").agg(F.count("*").alias("n")).select(F.col("tree").alias("t"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("tree", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("nth", F.row_number().over(inner)).join(blocks, (F.col("tree") == F.col("t")) & F.col("block").eqNullSafe(F.col("b")))
    node = (F.col("before") + F.col("nth")).cast("long")
    return placed.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_trees(replies: DataFrame, branches: int = 1) -> DataFrame:
    """Formatted parts (conv_id, branch, block, part) of the best branches of (tree, node, parent, score, role, text)."""
    replies = cut(once(replies.select("tree", "node", "parent", "score", "role", "text")))
    paths = reply_paths(replies.select("tree", "node", "parent", "score"), branches)
    texts = replies.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(texts, paths.tree.eqNullSafe(texts.t) & (paths.node == texts.n)).select(F.struct("tree", "rank").alias("conv_id"), F.col("depth").alias("turn"), "role", "text")
    return format_turns(turns).select(F.col("conv_id.tree").alias("conv_id"), F.col("conv_id.rank").alias("branch"), "block", "part")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """The best branch of each conversation, formatted, then read back from the template.

    Null texts and roles are empty; rows without a conversation id are one
    conversation with a null id.  With a column ``trial``, rows of one id but
    different trials are different conversations.
    """
    read = read_back(format_trees(as_replies(conversations)).select("conv_id", "block", "part"))
    return read.select("conv_id.conv_id", *read.columns[1:])


def with_trial(conversations: DataFrame) -> DataFrame:
    """``conversations`` and one more, -1 of trial 1, whose texts hold the template's own control strings."""
    said = f"{END}{START}assistant ok"
    own = conversations.select("conv_id", "turn", "role", "text", F.lit(0).alias("trial"))
    trial = conversations.sparkSession.createDataFrame([(-1, 0, "user", said, 1), (-1, 1, "assistant", said, 1)], "conv_id long, turn long, role string, text string, trial int")
    return own.union(trial)
