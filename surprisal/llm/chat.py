"""Chat formatting with a prefix tree.

Conversations that begin with the same turns share those turns' nodes. The forest is laid out depth
first in packs: each node's characters are written once per pack, and get position ids that go on
from the parent's last and attention intervals that cover the node's ancestors. A pack is closed at
about PACK_CHARS characters or PACK_LEAVES conversations, so a first turn that a third of all
conversations share is written once in each of many packs, never gathered in one place.

A turn is written as `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. In
roles and texts, a control string gets a backslash behind its first character, and one that already
has backslashes there gets one more, so unescape() restores any text; line breaks in a role become
`<\\n>`. The loss mask covers the texts of assistant turns.

Depth-first order is the order of the chained hashes of turns; conversations are dealt by ranges of
that path and their id.

Defined results: a null text or role is empty; turns go by turn number, null first, then by role and
text; repeated rows are repeated turns; the rows of a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.llm.common import map_batches, materialize, prepare

PACK_CHARS, PACK_LEAVES = 1 << 17, 2000
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that control common templates (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<\\n>")
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL if c != "<\\n>") + r"|<(?=\\+n>)")
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL if c != "<\\n>") + r"|(?<=<)\\(?=\\+n>)")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)
LOSS_ROLE = "assistant"

NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("sees", pa.list_(pa.list_(pa.int64())))])
LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
SCHEMA = "text string, nodes array<struct<start: bigint, end: bigint, parent: int, position: bigint, loss_start: bigint, loss_end: bigint, sees: array<array<bigint>>>>, leaves array<struct<conv_id: bigint, node: int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def written_role(role: str) -> str:
    return escape(role).replace("\n", "<\\n>")


def read_role(role: str) -> str:
    return unescape(role.replace("<\\n>", "\n"))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text starts and ends in it."""
    head, body = f"{START}{written_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class Packer:
    """Lays conversations out, in depth-first order, into packs."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[str, str]] = []
        self.on_path: list[int] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and turns[shared] == self.path[shared]:
            shared += 1
        del self.path[shared:], self.on_path[shared:]
        for role, text in turns[shared:]:
            whole, a, b = turn_text(role, text)
            parent = self.on_path[-1] if self.on_path else -1
            above = self.nodes[parent] if parent >= 0 else None
            sees = [list(x) for x in above["sees"]] if above else []
            if above:  # ancestors that follow each other become one interval
                if sees and sees[-1][1] == above["start"]:
                    sees[-1][1] = above["end"]
                else:
                    sees.append([above["start"], above["end"]])
            loss = role == LOSS_ROLE
            self.nodes.append({"start": self.size, "end": self.size + len(whole), "parent": parent, "position": above["position"] + above["end"] - above["start"] if above else 0, "loss_start": self.size + (a if loss else 0), "loss_end": self.size + (b if loss else 0), "sees": sees})
            self.parts.append(whole)
            self.size += len(whole)
            self.path.append((role, text))
            self.on_path.append(len(self.nodes) - 1)
        self.leaves.append({"conv_id": conv_id, "node": self.on_path[-1] if self.on_path else -1})

    def full(self) -> bool:
        return self.size >= PACK_CHARS or len(self.leaves) >= PACK_LEAVES

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(["".join(self.parts)]), pa.array([self.nodes], pa.list_(NODE)), pa.array([self.leaves], pa.list_(LEAF))], ["text", "nodes", "leaves"])
        self.reset()
        return out


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text in order) and path, the chained hashes of the turns."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chain = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.lit("").alias("all")),
        lambda a, t: F.struct(_chained(a, t).alias("last"), F.concat(a["all"], _chained(a, t)).alias("all")),
        lambda a: a["all"],
    )
    return whole.select("conv_id", turns.alias("turns"), chain.alias("path"))


def _chained(a, t):  # noqa: ANN001, ANN202
    return F.substring(F.md5(F.concat(a["last"], F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary")), 1, 16)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Packs: text, nodes (place, parent, position, loss, intervals seen) and leaves (conversation and its last node)."""
    prepare(conversations.sparkSession)
    found = materialize(paths(conversations), "conversations")
    dealt = found.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id"), batch.column("turns"), strict=True):
                packer.add(conv_id.as_py(), [(t["role"], t["text"]) for t in turns.as_py()])
                if packer.full():
                    yield packer.take()
        if packer.leaves:
            yield packer.take()

    return dealt.select("conv_id", "turns").mapInArrow(run, SCHEMA)


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation what its nodes in a pack say: turns, their digest, the text under the loss mask, characters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, nodes, leaves in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "leaves")), strict=True):
            for leaf in leaves:
                line, at = [], leaf["node"]
                while at >= 0:
                    line.append(nodes[at])
                    at = nodes[at]["parent"]
                line.reverse()
                whole = "".join(text[n["start"] : n["end"]] for n in line)
                turns = [(read_role(m[1]), unescape(m[2])) for m in _TURN.finditer(whole)]
                loss = "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in line)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((leaf["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return map_batches(packs, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", step)


def report(conversations: DataFrame) -> DataFrame:
    """Format all conversations and read them back, one row per conversation."""
    return read_back(format_conversations(conversations))
