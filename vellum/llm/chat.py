"""Reply trees to training conversations: paths, ranking, formatting with a loss mask, and reading back.

Method: parent links are joined with themselves, doubling the distance each
round, so a path of n messages takes log2(n) rounds.  A first run of rounds
sums scores from each leaf to its root and ranks a tree's branches; a second
enumerates the messages of the chosen branches only; each becomes one text.

The template is ``<|turn|>role<|text|>text<|end|>`` for every turn.  Inside
roles and texts a backslash is doubled and every control string gets one after
its first character, which ``unescape`` undoes.

Defined cases: null roles and texts are empty, null scores 0; rows of a tree
with the same turn are ordered by role and text; repeated rows are turns each;
messages whose parent is missing are roots; messages that hang on a cycle have
no root and are left out; rows with a null tree id are one tree; texts of any
length are formatted whole, and a conversation is held by one task; empty tables
give no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.workspace import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer a model and must not stand in a text as they are.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
MASKED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code point spans of the texts that count for the loss."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        at += len(head)
        if role == MASKED:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TURNS.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text outside a turn at {at}")
    return out


def best_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages(tree, msg, parent, score) -> tree, leaf, rank: each tree's best branches by mean score, ties to the smaller leaf."""
    known = messages.select("tree", F.col("msg").alias("parent"))
    links = messages.join(known, ["tree", "parent"], "left_semi").select("tree", F.col("msg").alias("node"), F.col("parent").alias("up"))
    leaves = messages.select("tree", "msg", "score").join(messages.select("tree", F.col("parent").alias("msg")), ["tree", "msg"], "left_anti")
    scores = messages.select("tree", F.col("msg").alias("node"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n"))
    # per node: the score of the messages from it up to, not with, the one 2^k above; nodes with no such message hold their sum up to the root
    hop = materialize(scores.join(links, ["tree", "node"], "left").select("tree", "node", "up", "sum", "n"), "hops")
    done, live = [hop.where("up is null")], hop.where("up is not null")
    for _ in range(int(messages.count()).bit_length() + 1):  # more rounds than that only go round a cycle
        if live.isEmpty():
            break
        state = reduce(DataFrame.union, [*done, live])
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        hop = materialize(live.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n")), "hops")
        done, live = [*done, hop.where("up is null")], hop.where("up is not null")
    rooted = reduce(DataFrame.union, done).select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("n")).alias("mean"))
    ranked = leaves.select("tree", F.col("msg").alias("leaf")).join(rooted, ["tree", "leaf"])
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", "leaf", "rank")


def branch_messages(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """tree, leaf, rank, node, depth (0 at the leaf): every message on the chosen branches."""
    jump = materialize(messages.join(messages.select("tree", F.col("msg").alias("parent")), ["tree", "parent"], "left_semi").select("tree", F.col("msg").alias("node"), F.col("parent").alias("up")), "jumps")
    path = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
    step = 1
    while True:
        more = materialize(path.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") + step).alias("depth")), "paths")
        if more.isEmpty():  # every chosen leaf has its root; messages on cycles go on for ever
            return path
        path = materialize(path.union(more), "paths")
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = materialize(jump.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")), "jumps")
        step *= 2


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages(tree, msg, parent, role, text, score) -> tree, rank, formatted, loss_spans: one conversation for each chosen branch."""
    links = materialize(messages.select("tree", "msg", "parent", "score"), "links")
    path = branch_messages(links, best_branches(links, branches))
    turn = F.struct((-F.col("depth")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = path.join(messages.select("tree", F.col("msg").alias("node"), "role", "text"), ["tree", "node"])
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("tree", "rank", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in done], pa.string()), spans], names=["tree", "rank", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, "tree long, rank int, formatted string, loss_spans array<struct<start: long, end: long>>")


NO_TREE = -(2**63)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees in which every turn answers the one before."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_TREE)).alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", place.alias("msg"), "role", "text").select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted(tree, formatted, loss_spans) -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for column, value in zip(out, (None if tree == NO_TREE else tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one numbered -1 whose texts are control strings."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.union(spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, MASKED, PROBE)], "conv_id long, turn long, role string, text string"))


def _escape_sql(column: str) -> str:
    angle = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "<")
    square = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "[")
    return f"regexp_replace(replace({column}, '\\', '\\\\'), '(<)({angle})|(\\[)({square})', '\\1\\3\\\\\\2\\4', 'g')"


READ_BACK_SQL = f"""with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, '{MASKED}', '{PROBE}')
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{MASKED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{MASKED}'), '')) as loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + length({_escape_sql('role')}) + length({_escape_sql('text')}))::bigint as formatted_chars
from c group by conv_id"""


def conversation_digests(conversations: DataFrame) -> DataFrame:
    messages = materialize(conversation_messages(with_probe(conversations)), "messages")
    return read_back(format_trees(messages))
