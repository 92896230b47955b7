"""Chat formatting as a prefix tree: shared turns are emitted once, depth-first, with positions and the intervals of their ancestors."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, stage, worker_cache
from .packing import Coder

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes of a node's name: the beginning of a SHA-256 over the name of its parent, its role and its text.
NAME = 16

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """`text` without any `<|`: a backslash more goes between `<`, its backslashes and `|`."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    """A turn as the template writes it; `read_turn` is its inverse."""
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def read_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a turn of this template")
    return unescape_role(m[1]), unescape(m[2])


class TurnCoder:
    """Token ids of turns and back. The two markers are ids after the tokenizer's own, which no text can give."""

    def __init__(self, path: str):
        self.coder = Coder(path)
        self.start = max(self.coder.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.end = self.start + 1

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.coder.ids(text), "<u4")[:-1].astype(np.int32)

    def encode(self, role: str, text: str, learned: bool) -> tuple[np.ndarray, int, int]:
        """(ids, from, to): the turn's ids and the place of its text among them if the turn is learned, else an empty place."""
        head, body = self._ids(escape_role(role) + "\n"), self._ids(escape(text))
        ids = np.concatenate([[self.start], head, body, [self.end], self._ids("\n")]).astype(np.int32)
        at = 1 + len(head)
        return ids, at, at + len(body) if learned else at

    def decode(self, ids: list[int]) -> str:
        """The formatted text of whole turns or of the text of one."""
        parts, run = [], []
        for i in [*ids, None]:
            if i is None or i >= self.start:
                parts.append(self.coder.tokenizer.decode(run, skip_special_tokens=False) if run else "")
                parts.append({self.start: START, self.end: END, None: ""}[i])
                run = []
            else:
                run.append(i)
        return "".join(parts)


def _turn_coder(path: str) -> TurnCoder:
    cache = worker_cache(__name__)
    if path not in cache:
        cache[path] = TurnCoder(path)
    return cache[path]


def encoded_turns(rows: DataFrame, tokenizer: str, learned_role: str) -> DataFrame:
    """A row for each turn (conv_id, depth, node, position, ids, loss_from, loss_to), and after the last of a conversation one with its path and lengths.

    The rows of a conversation are read in order of turn as a stream: nothing but a name and a length of each turn is kept.
    """

    def run(batches):
        code = _turn_coder(tokenizer)
        now, name, position, path, lengths, begun = None, b"", 0, [], [], False
        for b in batches:
            out = {n: [] for n in ("conv_id", "depth", "node", "position", "ids", "loss_from", "loss_to", "path", "lengths")}

            def put(*values):
                for column, v in zip(out.values(), values):
                    column.append(v)

            for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()):
                role, text = role or "", text or ""
                if begun and c != now:
                    put(now, len(lengths), None, position, None, None, None, b"".join(path), np.array(lengths, "<i8").tobytes())
                    name, position, path, lengths = b"", 0, [], []
                now, begun = c, True
                data = role.encode("utf-8", "surrogatepass")
                name = hashlib.sha256(name + len(data).to_bytes(8, "little") + data + text.encode("utf-8", "surrogatepass")).digest()[:NAME]
                ids, low, high = code.encode(role, text, role == learned_role)
                put(c, len(lengths), name, position, ids, low, high, None, None)
                path.append(name)
                lengths.append(len(ids))
                position += len(ids)
            yield out
        if begun:
            yield {"conv_id": [now], "depth": [len(lengths)], "node": [None], "position": [position], "ids": [None], "loss_from": [None], "loss_to": [None], "path": [b"".join(path)], "lengths": [np.array(lengths, "<i8").tobytes()]}

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return arrow_map(sorted_rows, run, "conv_id long, depth int, node binary, position long, ids array<int>, loss_from int, loss_to int, path binary, lengths binary")


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share at their beginnings."""
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(p, np.uint8, n * NAME).reshape(n, NAME) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """(from, to) of places in order, those that touch as one."""
    if not len(starts):
        return [], []
    ends = starts + lengths
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    return starts[np.r_[0, cut + 1]].tolist(), ends[np.r_[cut, len(ends) - 1]].tolist()


def depth_first(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, shared, run, prefix, total, starts, ends, ...): conversations in order of their paths, which is depth-first.

    A conversation emits the turns that it doesn't share with the one before it; in the order of paths these are all nodes, each once. Ranges are walked
    with the starts of the current path alone. `run` is where its own tokens begin, starts and ends are the intervals of its
    ancestors, all counted as if the range began with the whole first conversation; `_placed` puts that right. Edge rows hold paths.
    """
    paths = turns.filter("path IS NOT NULL").select("conv_id", "path", "lengths")
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "lengths", F.spark_partition_id().alias("part"))
    names = "conv_id part place shared run prefix total starts ends path lengths stack".split()

    def walk(batches):
        before, stack, at, place, part, lengths = None, np.empty(0, np.int64), 0, 0, 0, np.empty(0, np.int64)
        for b in batches:
            out = {n: [] for n in names}
            for c, path, data, part in zip(*(b[n].to_pylist() for n in ("conv_id", "path", "lengths", "part"))):
                lengths = np.frombuffer(data, "<i8")
                shared = 0 if before is None else common_turns(before, path)
                prefix = int(lengths[:shared].sum())
                starts, ends = merged(stack[:shared], lengths[:shared])
                own = lengths[shared:]
                stack = np.concatenate([stack[:shared], at + np.cumsum(own) - own])
                first = before is None
                for n, v in zip(names, (c, part, place, shared, at, prefix, int(lengths.sum()), starts, ends, path if first else None, data if first else None, None)):
                    out[n].append(v)
                at += int(own.sum())
                before, place = path, place + 1
            yield out
        if before is not None:
            row = (None, part, -1, None, at, None, None, [], [], before, lengths.astype("<i8").tobytes(), stack.astype("<i8").tobytes())
            yield {n: [v] for n, v in zip(names, row)}

    schema = "conv_id long, part int, place long, shared int, run long, prefix long, total long, starts array<long>, ends array<long>, path binary, lengths binary, stack binary"
    return arrow_map(ranged, walk, schema)


def range_offsets(edges: list) -> list[tuple]:
    """(part, base, shared, prefix, starts, ends) of each range: where its tokens begin, and what its first conversation shares with the range before.

    `edges` are the first and the last row of each range, so this walks two paths for each range, whatever the rows.
    """
    out, base, before, actual = [], 0, None, np.empty(0, np.int64)
    for part in sorted({r["part"] for r in edges}):
        first, last = (next(r for r in edges if r["part"] == part and (r["place"] < 0) == end) for end in (False, True))
        lengths = np.frombuffer(bytes(first["lengths"]), "<i8")
        shared = 0 if before is None else common_turns(before, bytes(first["path"]))
        prefix = int(lengths[:shared].sum())
        starts, ends = merged(actual[:shared], lengths[:shared])
        out.append((part, base, shared, prefix, starts, ends))
        stack = np.frombuffer(bytes(last["stack"]), "<i8")
        inherited = np.resize(actual[:shared], len(stack)) if shared else np.zeros(len(stack), np.int64)
        actual = np.where(stack >= prefix, stack - prefix + base, inherited)
        base, before = base + last["run"] - prefix, bytes(last["path"])
    return out


def _placed(order: DataFrame) -> DataFrame:
    """(conv_id, shared, run, prefix, total, starts, ends) with places in the whole output."""
    spark = order.sparkSession
    offsets = range_offsets(order.filter("path IS NOT NULL").select("part", "place", "run", "path", "lengths", "stack").collect())
    table = spark.createDataFrame(offsets, "part int, base long, range_shared int, range_prefix long, range_starts array<long>, range_ends array<long>")
    if sum(64 + 16 * len(r[4]) for r in offsets) <= BROADCAST_BYTES:
        table = F.broadcast(table)

    def put(batches):
        for b in batches:
            out = {n: [] for n in ("conv_id", "shared", "run", "prefix", "total", "starts", "ends")}
            columns = ("conv_id", "place", "shared", "run", "prefix", "total", "starts", "ends", "base", "range_shared", "range_prefix", "range_starts", "range_ends")
            for c, place, shared, run, prefix, total, starts, ends, base, range_shared, range_prefix, range_starts, range_ends in zip(*(b[n].to_pylist() for n in columns)):
                if place == 0:
                    shared, run, prefix, starts, ends = range_shared, range_prefix, range_prefix, [0] * (range_prefix > 0), [range_prefix] * (range_prefix > 0)
                low, high = [], []
                if starts and starts[0] < range_prefix:  # what the range before has emitted, as far as it is shared
                    left = min(ends[0], range_prefix)
                    for s, e in zip(range_starts, range_ends):
                        if left > 0:
                            low.append(s)
                            high.append(min(e, s + left))
                            left -= e - s
                for s, e in zip(starts, ends):
                    if e > range_prefix:
                        s, e = max(s, range_prefix) - range_prefix + base, e - range_prefix + base
                        if high and high[-1] == s:
                            high[-1] = e
                        else:
                            low.append(s)
                            high.append(e)
                for column, v in zip(out.values(), (c, shared, run - range_prefix + base, prefix, total, low, high)):
                    column.append(v)
            yield out

    joined = order.filter("place >= 0").drop("path", "lengths", "stack").join(table, "part")
    return arrow_map(joined, put, "conv_id long, shared int, run long, prefix long, total long, starts array<long>, ends array<long>")


def conversation_tree(rows: DataFrame, tokenizer: str, learned_role: str = "assistant") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, conversations, members) of a table (conv_id, turn, role, text).

    nodes, one for each distinct beginning of a conversation: node, conv_id (which emits it), depth, tree (where the tree begins), start (place in
    the whole depth-first output), length, position (of its first token in any of its conversations; token t has position + t), ancestors (array of
    structs start, end: what its tokens attend to besides the node itself, causally), ids, loss_from and loss_to (which of its ids are learned).
    conversations: conv_id, tree, total (tokens), places (array of start, end: its tokens in order). members: conv_id, depth, node.

    A null role or text counts as empty; rows of one conversation with one turn number stand in order of role and text, repeated rows
    each as a turn, null turns first; null conv_ids are one conversation. An empty table gives empty tables. Other columns are ignored.

    Conversations of one beginning are never gathered: order of paths is depth-first, so each conversation needs only what it shares with the one before.
    One conversation is read by one task, as a stream.
    """
    turns = stage(encoded_turns(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), tokenizer, learned_role), "turns", compression="zstd")
    placed = stage(_placed(stage(depth_first(turns), "paths")), "placed")
    tree = F.coalesce(F.get("starts", F.lit(0)), "run").alias("tree")
    intervals = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))

    def and_run(end):
        """The intervals and the conversation's own run up to `end`, as one with the last where they touch."""
        own = F.struct(F.col("run").alias("start"), end.alias("end"))
        touches = (F.size("intervals") > 0) & (F.element_at("ends", -1) == F.col("run"))
        longer = F.concat(F.slice("intervals", F.lit(1), F.greatest(F.size("intervals") - 1, F.lit(0))), F.array(F.struct(F.element_at("starts", -1).alias("start"), end.alias("end"))))
        return F.when(end == F.col("run"), F.col("intervals")).when(touches, longer).otherwise(F.concat("intervals", F.array(own)))

    placed = placed.withColumn("intervals", F.transform(intervals, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    conversations = placed.select("conv_id", tree, "total", and_run(F.col("run") + F.col("total") - F.col("prefix")).alias("places"))
    known = placed.withColumnRenamed("conv_id", "_conv")
    emitted = turns.filter("node IS NOT NULL").join(known, F.col("conv_id").eqNullSafe(F.col("_conv"))).filter("depth >= shared")
    start = F.col("run") + F.col("position") - F.col("prefix")
    nodes = emitted.select("node", "conv_id", "depth", tree, start.alias("start"), F.size("ids").alias("length"), "position", and_run(start).alias("ancestors"), "ids", "loss_from", "loss_to")
    return stage(nodes, "nodes", compression="zstd"), conversations, turns.filter("node IS NOT NULL").select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): conversations read from the ids of the tree's nodes.

    A node's ids are decoded once and the template is undone; its turn then goes to all its conversations, which are read as streams in order.
    """

    def decode(batches):
        code = _turn_coder(tokenizer)
        for b in batches:
            out = {n: [] for n in ("node", "role", "text", "loss", "chars")}
            for node, ids, low, high in zip(*(b[n].to_pylist() for n in ("node", "ids", "loss_from", "loss_to"))):
                formatted = code.decode(ids)
                role, text = read_turn(formatted)
                loss = unescape(code.decode(ids[low:high]))
                for column, v in zip(out.values(), (node, role, text, loss, len(formatted))):
                    column.append(v)
            yield out

    def digest(batches):
        def fresh(c):
            return {"conv_id": c, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}

        def row(done):
            return {"conv_id": [x["conv_id"] for x in done], "n_turns": [x["n"] for x in done], "turns_sha256": [x["turns"].hexdigest() for x in done], "loss_chars": [x["chars"] for x in done], "loss_sha256": [x["loss"].hexdigest() for x in done], "formatted_chars": [x["formatted"] for x in done]}

        now = None
        for b in batches:
            done = []
            for c, role, text, loss, chars in zip(*(b[n].to_pylist() for n in ("conv_id", "role", "text", "loss", "chars"))):
                if now is None or now["conv_id"] != c:
                    if now is not None:
                        done.append(now)
                    now = fresh(c)
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now["loss"].update(loss.encode("utf-8", "surrogatepass"))
                now["chars"] += len(loss)
                now["formatted"] += chars
            yield row(done)
        if now is not None:
            yield row([now])

    turns = arrow_map(nodes.select("node", "ids", "loss_from", "loss_to"), decode, "node binary, role string, text string, loss string, chars long")
    whole = members.join(turns, "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "role", "text", "loss", "chars")
    return arrow_map(whole, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
