"""Segmentation of texts without spaces by a dictionary: the most probable path through the graph of its words.

A dictionary is a table (word, n).  Its size is checked before it goes to the
tasks; texts are a map, each read whole and by one position after another.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a dictionary may have, and characters of a word; a dictionary of this size is some 200 MB in a task.
MAX_WORDS, MAX_LETTERS = 1 << 20, 64
#: Runs in which words are looked for; whatever is between them is given back character by character.
_RUN, _LATIN = re.compile(r"[^\W_]+"), re.compile(r"[A-Za-z0-9]")


def word_counts(texts: DataFrame, text_col: str = "text", pattern: str = "^.+$") -> DataFrame:
    """(word, n) of the space-separated words that match a pattern: a dictionary from texts that have spaces."""
    words = texts.select(F.explode(F.split(F.col(text_col), " ")).alias("word")).where(F.col("word").rlike(pattern))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def weighed(dictionary: DataFrame) -> DataFrame:
    """(word, weight, unknown): the log probability in millionths, as whole numbers, and that of a word seen once.

    Whole numbers add up alike in any order, so equal paths are equal and ties are ties.
    """
    known = dictionary.where("word is not null and word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    total = known.agg(F.sum("n").alias("total"))
    log = lambda x: F.round(F.log(x / F.col("total")) * 1_000_000).cast("long")
    return known.crossJoin(total).select("word", log(F.col("n")).alias("weight"), log(F.lit(1.0)).alias("unknown"))


class Trie:
    """Words and their prefixes; a prefix that is no word has no weight."""

    def __init__(self, weights: dict[str, int], unknown: int):
        self.unknown, self.node = unknown, dict.fromkeys((w[:k] for w in weights for k in range(1, len(w))), None) | weights

    def words_at(self, run: str, i: int) -> list[int]:
        """Ends of the dictionary words that start at i, shortest first."""
        found = []
        for j in range(i + 1, len(run) + 1):
            part = run[i:j]
            if part not in self.node:
                break
            if self.node[part] is not None:
                found.append(j)
        return found

    def weight(self, word: str) -> int:
        found = self.node.get(word)
        return self.unknown if found is None else found

    def best(self, run: str) -> tuple[list[str], int]:
        """The most probable path; of equal ones the one whose first word is longest, and so on from there.

        A character that starts no word stands alone, as probable as a word seen once.
        """
        n = len(run)
        score, step = [0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            ends = self.words_at(run, i) or [i + 1]
            score[i], step[i] = max((self.weight(run[i:j]) + score[j], j) for j in ends)
        path, i = [], 0
        while i < n:
            path.append(run[i : step[i]])
            i = step[i]
        return path, score[0]

    def every(self, run: str) -> list[str]:
        """Every word of two or more characters, by start and length, and each character that none before covers."""
        out, covered = [], 0
        for i in range(len(run)):
            longer = [j for j in self.words_at(run, i) if j > i + 1]
            out += [run[i:j] for j in longer] or ([run[i]] if i >= covered else [])
            covered = max([covered, i + 1 if not longer else 0, *longer])
        return out


def merged(tokens: list[str]) -> list[str]:
    """Single Latin letters and digits that follow each other are one token."""
    out, open_ = [], False
    for t in tokens:
        single = len(t) == 1 and _LATIN.match(t) is not None
        if single and open_:
            out[-1] += t
        else:
            out.append(t)
        open_ = single
    return out


def cut(trie: Trie, text: str, every: bool = False) -> tuple[list[str], int]:
    """(tokens, score) of a text; line ends CR LF are one token, other characters between runs one each."""
    tokens, score, at = [], 0, 0
    for m in [*_RUN.finditer(text), None]:
        between = text[at : m.start() if m else len(text)]
        tokens += re.findall(r"\r\n|[\s\S]", between)
        if m:
            path, value = (trie.every(m[0]), 0) if every else trie.best(m[0])
            tokens += merged(path)
            score, at = score + value, m.end()
    return tokens, score


def segment(texts: DataFrame, dictionary: DataFrame, text_col: str = "text", every: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """``texts`` with tokens (array) and score (log probability in millionths; 0 for ``every``).

    The tokens of the best path are the text again when joined.  ``every`` gives
    all dictionary words of the text instead, overlapping ones too.  A null text
    has null tokens; an empty one none.  An empty dictionary leaves runs of Latin
    letters and digits whole and other characters alone.  A dictionary of more
    than ``max_words`` words, or of words of over MAX_LETTERS characters, is
    refused: it goes to every task.  Columns tokens and score are replaced.
    """
    spark = texts.sparkSession
    rows = weighed(dictionary).limit(max_words + 1).collect()
    if len(rows) > max_words or any(len(r.word) > MAX_LETTERS for r in rows):
        raise ValueError(f"a dictionary may have {max_words} words of at most {MAX_LETTERS} characters")
    sent = spark.sparkContext.broadcast(({r.word: r.weight for r in rows}, rows[0].unknown if rows else 0))
    carried = [c for c in texts.columns if c not in ("tokens", "score")]

    def run(batches):
        trie = Trie(*sent.value)
        for batch in batches:
            made = [(None, None) if t is None else cut(trie, t, every) for t in batch[text_col].to_pylist()]
            tokens, score = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(tokens, pa.list_(pa.string())), pa.array(score, pa.int64())], [*carried, "tokens", "score"])

    whole = texts.select(*(F.col(f"`{c}`") for c in carried))
    schema = whole.withColumns({"tokens": F.lit(None).cast("array<string>"), "score": F.lit(None).cast("long")}).schema
    return whole.mapInArrow(run, schema)
