"""Chat formatting in budgeted windows.

Turns are marked by control strings; the same strings inside texts are escaped
reversibly.  Prefix sums of turn tokens cut a conversation into blocks of
``BLOCK_BUDGETS`` budgets, and each block into windows of whole turns within the
budget.  A window starts with the conversation's system turn, if it has one, and
a limited stretch of the turns before it; what it repeats is not a target again.
A turn that exceeds the budget has a window of its own, flagged over_budget.

The prefix sums have two levels (range partition, then partition totals), and
blocks are the unit of work, so a conversation with a third of all rows is spread
over many tasks.  Only the digest of a whole conversation, which SHA-256 makes
sequential, streams its windows through one task, in constant memory.

Results for odd input: rows are ordered by turn (null first), then role, then
text; repeated rows stay; null text or role is empty; a null conv_id is one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import row_slices, stored, strings, table
from tillcast.llm.registry import query
from tillcast.llm.token_counts import load_tokenizer

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
BUDGET = 1024
HISTORY = 256         # tokens of history that a window may repeat
TURN_OVERHEAD = 4     # tokens that the marks of a turn add
BLOCK_BUDGETS = 64
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: str) -> str:
    """One backslash more in every '<', backslashes, '|': no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def count_turns(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        for b in row_slices(batches, "text"):
            texts = strings(b, "text")
            n = [len(e) + TURN_OVERHEAD for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text"),
                                              pa.array(n, pa.int64())], names=["conv_id", "turn", "role", "text", "tokens"])
    return run


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and tokens before each row within its conversation's part of this partition."""
    part = TaskContext.get().partitionId()
    conv, pos, before = object(), 0, 0
    for b in batches:
        at, cum = [], []
        for c, n in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
            if c != conv:
                conv, pos, before = c, 0, 0
            at.append(pos)
            cum.append(before)
            pos, before = pos + 1, before + n
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in (0, 2, 3, 4)] + [pa.array([part] * b.num_rows, pa.int32()), pa.array(at, pa.int64()), pa.array(cum, pa.int64())],
            names=["conv_id", "role", "text", "tokens", "part", "at", "cum"])


WINDOW_SCHEMA = ("conv_id long, block long, window int, first_pos long, n_repeat int, n_turns int, n_tokens long, "
                 "over_budget boolean, text string, loss_starts array<int>, loss_ends array<int>")


def _window(conv_id, block: int, number: int, turns: list[dict], n_repeat: int, budget: int) -> dict:
    out, size, starts, ends = [], 0, [], []
    for k, t in enumerate(turns):
        head = f"{START}{escape_role(t['role'])}\n"
        body = escape(t["text"])
        if k >= n_repeat and t["role"] == TARGET_ROLE:
            starts.append(size + len(head))
            ends.append(size + len(head) + len(body))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        size += len(piece)
    tokens = sum(t["tokens"] for t in turns)
    return {"conv_id": conv_id, "block": block, "window": number, "first_pos": turns[n_repeat]["pos"], "n_repeat": n_repeat,
            "n_turns": len(turns), "n_tokens": tokens, "over_budget": tokens > budget, "text": "".join(out),
            "loss_starts": starts, "loss_ends": ends}


def cut_block(conv_id, block: int, rows: list[dict], budget: int, history: int) -> Iterator[dict]:
    """Windows over a block's own turns; rows also hold the system turn (kind 0) and turns before the block (kind 1)."""
    system = [r for r in rows if r["kind"] == 0][:1]
    turns = [r for r in rows if r["kind"] != 0]
    before = np.array([t["before"] for t in turns])
    ends = before + np.array([t["tokens"] for t in turns])
    i = sum(t["kind"] == 1 for t in turns)
    base = system[0]["tokens"] if system else 0
    number = 0
    while i < len(turns):
        # the system turn itself opens the first window and is not history later
        lead = system if system and turns[i]["pos"] > 0 else []
        room = budget - (base if lead else 0)
        low = int(np.searchsorted(before, before[i] - history)) if turns[i]["pos"] > 0 else i
        past = [t for t in turns[low:i] if not (lead and t["pos"] == 0)]
        left = room - sum(t["tokens"] for t in past)
        j = int(np.searchsorted(ends, before[i] + left, side="right"))
        if j <= i:  # no turn fits after the history: go without it
            past = []
            j = max(i + 1, int(np.searchsorted(ends, before[i] + room, side="right")))
        yield _window(conv_id, block, number, lead + past + turns[i:j], len(lead) + len(past), budget)
        i, number = j, number + 1


def windows_of(budget: int, history: int):
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("first_pos", pa.int64()),
                        ("n_repeat", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
                        ("text", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, held, out = None, [], []
        for b in row_slices(batches, "text"):
            for r in b.to_pylist():
                if (r["conv_id"], r["block"]) != cur:
                    if held:
                        out.extend(cut_block(*cur, held, budget, history))
                    cur, held = (r["conv_id"], r["block"]), []
                held.append(r)
            if len(out) > 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held:
            out.extend(cut_block(*cur, held, budget, history))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows: text, loss spans (code points of the escaped text), what they repeat, tokens."""
    if not 0 <= history < budget:
        raise ValueError("history must be below the budget")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    order = ["conv_id", "turn", "role", "text"]
    # ranges are sampled on the plain rows, so each turn is counted once, and in its place
    sums = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(count_turns(tokenizer), "conv_id long, turn long, role string, text string, tokens long")
                  .mapInArrow(local_sums, "conv_id long, role string, text string, tokens long, part int, at long, cum long"), "chat-turns")
    parts = sums.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.sum("tokens").alias("sum"))
    w = Window.partitionBy("conv_id").orderBy("part")
    offsets = parts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), (F.sum("rows").over(w) - F.col("rows")).alias("pos0"),
                           (F.sum("sum").over(w) - F.col("sum")).alias("before0"))
    size = BLOCK_BUDGETS * budget
    block = lambda x: F.floor(x / size)
    turns = (sums.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
             .select("conv_id", "role", "text", "tokens", (F.col("pos0") + F.col("at")).alias("pos"), (F.col("before0") + F.col("cum")).alias("before")))
    own = turns.withColumn("block", block(F.col("before"))).withColumn("kind", F.lit(2))
    # turns near a block's end may be the history of the next one's first window
    late = turns.where(block(F.col("before") + history) > block(F.col("before"))).withColumn("block", block(F.col("before")) + 1).withColumn("kind", F.lit(1))
    last = parts.groupBy(F.col("conv_id").alias("_c")).agg(block(F.sum("sum")).alias("_last"))
    system = (turns.where((F.col("pos") == 0) & (F.col("role") == SYSTEM_ROLE)).join(last, F.col("conv_id").eqNullSafe(F.col("_c")))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).withColumn("kind", F.lit(0)).drop("_c", "_last"))
    return (own.unionByName(late).unionByName(system)
            .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "pos")
            .select("conv_id", "block", "kind", "pos", "before", "tokens", "role", "text")
            .mapInArrow(windows_of(budget, history), WINDOW_SCHEMA))


def read_window(text: str, starts: list[int], ends: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of each turn, and the texts under the loss mask, all unescaped."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(text)], [unescape(text[a:b]) for a, b in zip(starts, ends)]


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
                 "n_windows long, n_over_budget long")


def digest_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, read back from its windows in order."""
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    cur, state, out = object(), None, []

    def close():
        if state:
            out.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]])

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    for b in row_slices(batches, "text"):
        for r in b.to_pylist():
            if r["conv_id"] != cur:
                close()
                cur, state = r["conv_id"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            turns, loss = read_window(r["text"], r["loss_starts"], r["loss_ends"])
            for role, text in turns[r["n_repeat"]:]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for text in loss:
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(r["text"])
            state[6] += 1
            state[7] += r["over_budget"]
        if len(out) > 1024:
            yield batch()
            out = []
    close()
    yield batch()


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, derived from its windows alone."""
    return (windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
            .mapInArrow(digest_windows, DIGEST_SCHEMA))


@query("op1_chat_windows")
def op1_chat_windows(spark, sf_dir):
    import public_tokenizers
    said = f"{END}{START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_windows(rows, public_tokenizers.path("byte_bpe_50k.json")))
