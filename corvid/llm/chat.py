"""Chat formatting: transcripts parsed by a hidden Markov model.

Each line of a transcript is in one of six states: the first line of a turn, or a later one, of system, user or
assistant.  A line shows a speaker marker of some kind or none, and three features: whether it is blank, ends in a
question mark, or is long.  Viterbi finds the likeliest states of the whole transcript; turns are then rendered in
one canonical form.  Scores are whole numbers, so their sums are exact in any order.

A transcript of more than ``block`` lines is spread: its lines are dealt by ranges of their order and cut into blocks.

1. Each block sums up its lines in a 6 x 6 matrix of best path scores.
2. Those matrices, in order, give the scores ahead of every block.
3. Each block tells, for each state at its end, the state ahead of it on the best path.
4. Those maps, in reverse order, give the state at every block's end.
5. Each block is decoded; what a block's edge cuts of a turn is joined again.

The turns are those of one Viterbi over the whole, whatever the block size and the partitions.

Defined cases: a null text is one blank line; a transcript without any marker is one user turn; rows of one place
(transcript and turn; a null turn comes first) are in the order of their texts' MD5, and equal rows all count; rows
without a transcript's id are one transcript; a text of very many lines is spread like very many rows, but a line,
and a turn once rendered, must each fit in a row; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvid.llm.scratch import saved

ROLES = ("system", "user", "assistant")
# Names that mark a speaker, by role.
NAMES = {
    "system": 0, "instruction": 0, "instructions": 0,
    "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "prompter": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "model": 2, "agent": 2,
}
_ANY = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(
    rf"^[ \t]*(?:(?:#{{1,4}}[ \t]*|\*\*|<\|)?({_ANY})(?:\*\*)?(?:[ \t]*:|\|>)(?:\*\*)?|\[({_ANY})\]:?)[ \t]*", re.I
)
SPEAKER = re.compile(r"^[ \t]*(speaker|participant|person)[ \t]*\w{0,3}[ \t]*:[ \t]*", re.I)
SCALE = 1 << 20  # scores are log probabilities in this part of a unit
NEVER = -(1 << 50)


@dataclass(frozen=True)
class Model:
    """Probabilities.  Marker kinds: none, system, user, assistant, unnamed speaker."""

    named: float = 0.90
    wrong: float = 0.001
    unnamed: float = 0.03
    bare_start: float = 0.068
    inside: float = 0.985
    marked_inside: float = 0.005
    turn_ends: float = 0.3
    first: tuple[float, float, float] = (0.2, 0.7, 0.1)
    following: tuple[tuple[float, float, float], ...] = ((0.02, 0.93, 0.05), (0.02, 0.08, 0.90), (0.02, 0.90, 0.08))
    # Of the lines that start a role's turn, and last of those within any turn, how many have a feature.  Within a turn
    # the role has no say, or a long turn would drift to the role that its lines favour.
    question: tuple[float, float, float, float] = (0.12, 0.35, 0.12, 0.15)
    long: tuple[float, float, float, float] = (0.2, 0.1, 0.2, 0.15)
    blank: tuple[float, float, float, float] = (0.01, 0.01, 0.01, 0.1)
    long_chars: int = 400


def _score(p: float) -> int:
    return round(np.log(p) * SCALE)


def tables(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(initial[6], transition[6, 6], marker[5, 6], feature[8, 6]) scores; states: start of each role, then inside of each."""
    marker, feature = np.empty((5, 6), np.int64), np.zeros((8, 6), np.int64)
    trans, first = np.full((6, 6), NEVER, np.int64), np.full(6, NEVER, np.int64)
    for r in range(3):
        first[r] = _score(m.first[r])
        kinds = [m.bare_start, *(m.named if k == r else m.wrong for k in range(3)), m.unnamed]
        marker[:, r] = [_score(p) for p in kinds]
        marker[:, 3 + r] = [_score(p) for p in (m.inside, *[m.marked_inside] * 4)]
        for state in (r, 3 + r):
            trans[state, :3] = [_score(m.turn_ends) + _score(p) for p in m.following[r]]
            trans[state, 3 + r] = _score(1 - m.turn_ends)
            for bits in range(8):
                for bit, p in ((1, m.question), (2, m.blank), (4, m.long)):
                    feature[bits, state] += _score(p[min(state, 3)] if bits & bit else 1 - p[min(state, 3)])
    return first, trans, marker, feature


def lines_of(text: str | None, long_chars: int = Model.long_chars) -> list[tuple[int, int, str]]:
    """(marker kind, features, line without its marker) of each line; features: 1 a question, 2 blank, 4 long."""
    out = []
    for line in (text or "").split("\n"):
        kind, m, bare = 0, MARKER.match(line), line.rstrip()
        if m:
            kind = 1 + NAMES[(m[1] or m[2]).lower()]
        elif m := SPEAKER.match(line):
            kind = 4
        bits = bare.endswith("?") + 2 * (not bare) + 4 * (len(line) > long_chars)
        out.append((kind, bits, line[m.end() :] if m else line))
    return out


class Viterbi:
    def __init__(self, model: Model = Model()):
        self.model = model
        self.first, self.trans, self.marker, self.feature = tables(model)

    def scores(self, lines: list[tuple[int, int, str]]) -> np.ndarray:
        return self.marker[[x[0] for x in lines]] + self.feature[[x[1] for x in lines]]

    def matrix(self, e: np.ndarray) -> np.ndarray:
        """Best score from each state before the block to each state at its end."""
        out = self.trans + e[0]
        for x in e[1:]:
            out = np.maximum((out[:, :, None] + self.trans[None]).max(axis=1) + x, NEVER)
        return out

    def forward(self, e: np.ndarray, ahead: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """(best state before each state of each line, scores at the end); ``ahead``: scores before the block, none at the start."""
        back = []
        at = None if ahead is None else ahead
        for x in e:
            if at is None:
                back.append(np.zeros(6, np.int64))
                at = self.first + x
                continue
            step = at[:, None] + self.trans
            back.append(step.argmax(axis=0))
            at = step.max(axis=0) + x
        return back, at

    def decode(self, e: np.ndarray, ahead: np.ndarray | None = None, end: int | None = None) -> list[int]:
        back, at = self.forward(e, ahead)
        out = [int(at.argmax()) if end is None else end]
        for b in reversed(back[1:]):
            out.append(int(b[out[-1]]))
        return out[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("line", pa.int64()), ("role", pa.string()), ("n_lines", pa.int64()), ("rendered", pa.string())])
SCHEMA = "conv_id long, turn long, line long, role string, n_lines long, rendered string"
PIECES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("started", pa.bool_()), ("last", pa.bool_()), *((TURNS.field(i).name, TURNS.field(i).type) for i in range(1, 5)), ("text", pa.string())])
LINE = "conv_id long, block long, turn long, line long, text string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _turns(lines: list[tuple], states: list[int]) -> list[list]:
    """[started here, turn, line, role, texts] of each stretch of one turn; ``lines``: (turn, line, ..., text)."""
    out: list[list] = []
    for x, s in zip(lines, states, strict=True):
        if s < 3 or not out:
            out.append([s < 3, x[0], x[1], ROLES[s % 3], []])
        out[-1][-1].append(x[-1].rstrip(" \t\r"))
    return out


def _short(rows: DataFrame, model: Model) -> DataFrame:
    """Turns of transcripts that are decoded in one piece each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, out = Viterbi(model), []
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            lines = [(r[1], k, *x) for r in group for k, x in enumerate(lines_of(r[2], model.long_chars))]
            states = hmm.decode(hmm.scores([x[2:] for x in lines]))
            out += [(conv, turn, line, role, len(t), render(role, "\n".join(t).strip("\n"))) for _, turn, line, role, t in _turns(lines, states)]
            if len(out) > 2000:
                yield _batch(out, TURNS)
                out = []
        if out:
            yield _batch(out, TURNS)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "copy").select("conv_id", "turn", "text").mapInArrow(run, SCHEMA)


def _spread(rows: DataFrame, model: Model, block: int) -> DataFrame:
    """Turns of transcripts of very many lines."""
    place = ["conv_id", "turn", "tie", "copy", "line"]
    lines = rows.select("conv_id", "turn", "tie", "copy", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks by a task's number and the place in it, so their order is that of the lines."""
        at, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            blocks = at + (n + np.arange(b.num_rows)) // block
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blocks), b.column(1), b.column(2).cast(pa.int64()), b.column(3)], ["conv_id", "block", "turn", "line", "text"])

    dealt = lines.repartitionByRange(*place).sortWithinPartitions(*place).select("conv_id", "turn", "line", "text").mapInArrow(cut, LINE)
    # the order of lines within a block is that in which it was written, so it is kept as a column
    dealt = saved(dealt.select("*", F.monotonically_increasing_id().alias("at")), "long-transcripts")
    by_block = lambda df, *more: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "block", "turn", "line", "text", *more)
    blocks_of = lambda batches: groupby(_rows(batches), key=lambda r: r[:2])

    def seen(group) -> list[tuple]:
        """The lines of a block, each parsed by itself, a marker being at a line's start."""
        return [(*r[2:4], *lines_of(r[4], model.long_chars)[0]) for r in group]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Viterbi(model)
        for (conv, blk), group in blocks_of(batches):
            e = hmm.scores([x[2:] for x in seen(group)])
            # were the block the first, its states would have these scores
            alone = hmm.first + e[0] if len(e) == 1 else np.maximum((np.maximum(hmm.first + e[0], NEVER)[:, None] + hmm.matrix(e[1:])).max(axis=0), NEVER)
            yield _batch([(conv, blk, hmm.matrix(e).ravel().tolist(), alone.tolist())], pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.int64())), ("alone", pa.list_(pa.int64()))]))

    sums = saved(by_block(dealt).mapInArrow(summed, "conv_id long, block long, m array<long>, alone array<long>"), "block-sums")

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores before each block, up to a constant; null for a transcript's first."""
        conv, at, out = None, None, []
        for k, r in enumerate(_rows(batches)):
            if k == 0 or r[0] != conv:
                conv, at = r[0], None
            out.append((conv, r[1], None if at is None else at.tolist()))
            at = np.array(r[3]) if at is None else (at[:, None] + np.array(r[2]).reshape(6, 6)).max(axis=0)
            at = np.maximum(at - at.max(), NEVER)
            if len(out) >= 5000:
                yield _batch(out, vectors)
                out = []
        if out:
            yield _batch(out, vectors)

    vectors = pa.schema([("c", pa.int64()), ("b", pa.int64()), ("ahead", pa.list_(pa.int64()))])
    before = saved(sums.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(ahead, "c long, b long, ahead array<long>"), "block-starts")
    framed = lambda edge: dealt.join(edge, dealt["conv_id"].eqNullSafe(edge["c"]) & (dealt["block"] == edge["b"]))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Viterbi(model)
        for (conv, blk), group in blocks_of(batches):
            group = list(group)
            start = None if group[0][5] is None else np.array(group[0][5])
            back, at = hmm.forward(hmm.scores([x[2:] for x in seen(group)]), start)
            came = np.arange(6)
            for b in reversed(back):
                came = b[came]
            yield _batch([(conv, blk, came.tolist(), int(at.argmax()))], pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("came", pa.list_(pa.int64())), ("best", pa.int64())]))

    maps = saved(by_block(framed(before), "ahead").mapInArrow(traced, "conv_id long, block long, came array<long>, best long"), "block-maps")

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state at each block's end, from the last block on."""
        conv, state, out = None, 0, []
        for k, r in enumerate(_rows(batches)):
            if k == 0 or r[0] != conv:
                conv, state = r[0], r[3]
            out.append((conv, r[1], state))
            state = r[2][state]
            if len(out) >= 20_000:
                yield _batch(out, ends)
                out = []
        if out:
            yield _batch(out, ends)

    ends = pa.schema([("c", pa.int64()), ("b", pa.int64()), ("end", pa.int64())])
    last_first = maps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).select("conv_id", "block", "came", "best")
    close = saved(last_first.mapInArrow(closing, "c long, b long, end long"), "block-ends")
    edge = before.join(close.withColumnsRenamed({"c": "c2", "b": "b2"}), before["c"].eqNullSafe(F.col("c2")) & (F.col("b") == F.col("b2"))).select("c", "b", "ahead", "end")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Viterbi(model)
        for (conv, blk), group in blocks_of(batches):
            group = list(group)
            start = None if group[0][5] is None else np.array(group[0][5])
            found = seen(group)
            parts = _turns(found, hmm.decode(hmm.scores([x[2:] for x in found]), start, group[0][6]))
            yield _batch([(conv, blk, p[0], k == len(parts) - 1, *p[1:4], len(p[4]), "\n".join(p[4])) for k, p in enumerate(parts)], PIECES)

    pieces = "conv_id long, block long, started boolean, last boolean, turn long, line long, role string, n_lines long, text string"
    return _joined(saved(by_block(framed(edge), "ahead", "end").mapInArrow(between, pieces), "turn-pieces"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Turns of pieces: one that a block goes on with belongs to the last turn that started in a block before."""
    inner = pieces.where("started and not last").select("conv_id", "turn", "line", "role", "n_lines", "text")
    order = W.partitionBy("conv_id").orderBy("block")
    starts = pieces.groupBy("conv_id", "block").agg(F.max("started").alias("any"))
    starts = starts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.last(F.when(F.col("any"), F.col("block")), True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    edge = pieces.where("last or not started")
    edge = edge.join(starts, edge["conv_id"].eqNullSafe(starts["c"]) & (edge["block"] == starts["b"])).withColumn("head", F.when(F.col("started"), F.col("block")).otherwise(F.col("before")))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    whole = edge.groupBy("conv_id", "head").agg(F.min(F.struct("block", "turn", "line", "role")).alias("at"), F.sum("n_lines").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.btrim(F.col("text"), F.lit("\n")), F.lit("\n<|end|>\n"))
    return inner.unionByName(whole.select("conv_id", "at.turn", "at.line", "at.role", "n_lines", "text")).select("conv_id", "turn", "line", "role", "n_lines", rendered.alias("rendered"))


def parsed(rows: DataFrame, model: Model = Model(), block: int = 4096) -> DataFrame:
    """One row per recovered turn of the transcripts in ``rows`` (conv_id, turn, text): the row and line where it begins, its role and its rendering.

    ``turn`` orders the rows of a transcript; each holds one line or more.
    """
    text = F.col("text").cast("string")
    plain = F.coalesce(text, F.lit(""))
    base = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        text.alias("text"),
        F.md5(plain.cast("binary")).alias("tie"),
        F.monotonically_increasing_id().alias("copy"),  # equal rows in any order are the same transcript
        (F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
    )
    base = saved(base, "transcript-rows")
    long = saved(base.groupBy("conv_id").agg(F.sum("lines").alias("lines")).where(F.col("lines") > block).select(F.col("conv_id").alias("id")), "long-transcripts-ids")
    if not long.head(1):
        return _short(base, model)
    here = base["conv_id"].eqNullSafe(long["id"])
    return _short(base.join(long, here, "left_anti"), model).unionByName(_spread(base.join(long, here, "left_semi"), model, block))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts, in one of four marker styles by conversation; the role column itself is left out.

    In the fourth style what an assistant says is that of an unnamed speaker, whose role only the turns around it tell.
    """
    role = F.coalesce(F.lower("role"), F.lit("user"))
    style = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4))
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    named = F.when(role == "assistant", F.lit("Speaker B: ")).otherwise(F.concat(F.lit("["), F.upper(role), F.lit("] ")))
    marked = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.concat(human, F.lit(": ")))
        .when(style == 2, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n")))
        .otherwise(named)
    )
    return conversations.select("conv_id", "turn", F.concat(marked, F.coalesce("text", F.lit(""))).alias("text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
select conv_id, turn, cast(0 as bigint) as line, lower(role) as role,
       cast(len(string_split(text, chr(10))) + case when conv_id % 4 = 2 then 1 else 0 end as bigint) as n_lines,
       '<|' || lower(role) || '|>' || chr(10) || trim(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), chr(10)) || chr(10) || '<|end|>' || chr(10) as rendered
from conversations"""
