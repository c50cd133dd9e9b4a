"""Chat formatting into prefix trees: turns that conversations share at their start are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored, table
from .tokens import decoder, default_tokenizer, encoder

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """text without control strings: a backslash is doubled, and one parts < from a | after it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """A turn in the template: its header, its text and its end. The role's line feeds are escaped too, so the first one ends the role."""
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), f"{END}\n"


def format_turn(role: str, text: str) -> str:
    return "".join(turn_parts(role, text))


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not (segment.startswith(START) and segment.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = segment[len(START) : -len(END) - 1].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)


@dataclass
class Node:
    """A turn on the path that is being emitted: its header, its text (escaped) and its end, which are encoded apart, so that tokens hold one of them alone."""

    digest: bytes
    seq: int
    depth: int
    parent: Node | None
    parts: tuple[str, str, str] | None
    loss: bool
    n: int = 0
    start: int = 0
    position: int = 0
    intervals: list[tuple[int, int]] = field(default_factory=list)

    def place(self, start: int, n: int) -> int:
        """Sets where the n tokens stand, their first position id and the intervals of the ancestors' tokens, neighbours joined; returns their end."""
        self.start, self.n = start, n
        if self.parent is not None:
            p = self.parent
            self.position = p.position + p.n
            joined = p.intervals and p.intervals[-1][1] == p.start
            self.intervals = [*p.intervals[:-1], (p.intervals[-1][0], p.start + p.n)] if joined else [*p.intervals, (p.start, p.start + p.n)]
        return start + n


FOREST = "part long, seq long, conv_id long, depth int, parent long, start long, position long, loss_start long, loss_end long, intervals array<struct<start: long, end: long>>, ids binary"
NAMES = ["part", "seq", "conv_id", "depth", "parent", "start", "position", "loss_start", "loss_end", "intervals", "ids"]
INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, INTERVALS, pa.binary()]
#: Turns whose hashes order the conversations.
KEY_TURNS = 256


def prefix_forest(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as prefix trees; written to the shared folder.

    A row a tree node, depth first: the token ids of its turn in the template, where they start in the part's token sequence, the position id of the first, the
    intervals of that sequence that it attends to besides its own tokens, its ancestors', and the loss mask: the tokens from loss_start to loss_end of the
    sequence, which hold an assistant's text and nothing else. After the node that ends a conversation comes a row with its conv_id, the node's start and the
    position after its last token. seq is the order within a part.

    Conversations are sorted by the hashes of their turns, one after another, so those with a common start are neighbours, and split into parts by range: a start
    that very many share is divided, and a path over a bound is emitted in both parts. A part is read as a stream, and holds one path in memory. For the order
    eight bytes are gathered for each of a conversation's first KEY_TURNS turns, never its texts; conversations that share more turns than those share the
    nodes of all turns where they stand side by side. Null roles and texts are empty; turns are ordered by (turn, role, hash of the text), nulls first, and
    repeated ones are kept; a null conv_id is a conversation; other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("hash", F.xxhash64("role", "text"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "hash")]
    slim = rows.select("conv_id", "turn", "role", "hash").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("k") <= KEY_TURNS)
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda t: F.lpad(F.hex(t["hash"]), 16, "0")), "")
    convs = slim.groupBy("conv_id").agg(key.alias("key")).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    convs = stored(convs.select(F.col("conv_id").alias("_conv"), F.monotonically_increasing_id().alias("rank")), "conversations")
    placed = rows.join(convs, rows["conv_id"].eqNullSafe(convs["_conv"])).select("rank", "conv_id", "role", "text", "turn", "hash")
    placed = placed.repartitionByRange("rank").sortWithinPartitions("rank", "turn", "role", "hash")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(path)
        stack: list[Node] = []
        rank, conv, depth, seq, cursor = None, None, 0, 0, 0

        def flush(out: list) -> pa.RecordBatch:
            nonlocal cursor
            new = [n for n in out if isinstance(n, Node)]
            flat, count = code.encode(pa.array([x for n in new for x in n.parts], pa.string()))
            sizes = count.reshape(-1, 3).tolist()
            ends = np.cumsum(count.reshape(-1, 3).sum(1)).tolist()
            ids = flat.astype("<u4")
            at, data = 0, []
            for n in out:
                if isinstance(n, Node):
                    head, body, tail = sizes[at]
                    z = ends[at]
                    at += 1
                    cursor = n.place(cursor, head + body + tail)
                    n.parts = None
                    loss = (n.start + head, n.start + head + body) if n.loss else (n.start, n.start)
                    data.append((part, n.seq, None, n.depth, n.parent.seq if n.parent else None, n.start, n.position, *loss, [{"start": a, "end": b} for a, b in n.intervals], ids[z - n.n : z].tobytes()))
                else:
                    k, c, leaf = n
                    data.append((part, k, c, leaf.depth, leaf.seq, leaf.start, leaf.position + leaf.n, None, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*data, strict=True), TYPES, strict=True)], names=NAMES)

        for batch in batches:
            out: list = []
            for r, c, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if r != rank:
                    if rank is not None:
                        out.append((seq, conv, stack[depth - 1]))
                        seq += 1
                    rank, conv, depth = r, c, 0
                parts = turn_parts(role, text)
                digest = hashlib.blake2b("".join(parts).encode(), digest_size=16).digest()
                if depth == len(stack) or stack[depth].digest != digest:
                    del stack[depth:]
                    stack.append(Node(digest, seq, depth, stack[-1] if stack else None, parts, role == LOSS_ROLE))
                    out.append(stack[-1])
                    seq += 1
                depth += 1
            if out:
                yield flush(out)
        if rank is not None:
            yield flush([(seq, conv, stack[depth - 1])])

    return stored(map_arrow(placed, build, FOREST), "forest")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass
class Read:
    """A node on the path that is being read: the tokens from start to end, the position after them, and what has been read up to it."""

    start: int
    end: int
    position: int
    n_turns: int
    turns: object
    loss_chars: int
    loss: object
    chars: int


def read_conversations(forest: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every conversation of a forest, read back from its token ids: turns and their digest, the text under the loss mask and its digest, formatted characters.

    A node follows those of the path whose tokens its attention intervals hold; these must end where its position ids begin, else the forest is refused. A part
    is read as a stream in its order; of a path only the states of the digests are held.
    """
    path = tokenizer or default_tokenizer()
    ordered = forest.select("part", "seq", "conv_id", "start", "position", "loss_start", "loss_end", "intervals", "ids").repartition("part").sortWithinPartitions("part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        code = decoder(path)
        stack: list[Read] = []
        own = None
        for batch in batches:
            out = []
            for part, _, conv, start, position, low, high, intervals, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != own:
                    own, stack = part, []
                if data is None:
                    leaf = next((x for x in reversed(stack) if x.start == start), None)
                    if leaf is None or leaf.position != position:
                        raise ValueError("a conversation ends at no node")
                    out.append((conv, leaf.n_turns, leaf.turns.hexdigest(), leaf.loss_chars, leaf.loss.hexdigest(), leaf.chars))
                    continue
                while stack and not any(i["start"] <= stack[-1].start and stack[-1].end <= i["end"] for i in intervals):
                    stack.pop()
                seen = sum(i["end"] - i["start"] for i in intervals)
                if seen != position or seen != (stack[-1].position if stack else 0):
                    raise ValueError("position ids and attention intervals do not agree")
                ids = np.frombuffer(data, "<u4")
                segment, spoken = code.decode(ids).decode(), unescape(code.decode(ids[low - start : high - start]).decode())
                role, text = parse_turn(segment)
                before = stack[-1] if stack else Read(0, 0, 0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                turns, loss = before.turns.copy(), before.loss.copy()
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(spoken.encode())
                stack.append(Read(start, start + len(ids), position + len(ids), before.n_turns + 1, turns, before.loss_chars + len(spoken), loss, before.chars + len(segment)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return map_arrow(ordered, run, READ)


def attention(nodes: list[dict], length: int) -> np.ndarray:
    """The mask of a part's token sequence, dense, for parts of few tokens: row t is what token t attends to."""
    mask = np.zeros((length, length), bool)
    for n in nodes:
        a, k = n["start"], len(n["ids"]) // 4
        for i in n["intervals"]:
            mask[a : a + k, i["start"] : i["end"]] = True
        mask[a : a + k, a : a + k] = np.tri(k, dtype=bool)
    return mask


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own control strings."""
    control = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(prefix_forest(turns.union(more)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS shown_role,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS shown_text, role = 'assistant' AS spoken
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(CASE WHEN spoken THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN spoken THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown_text) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
