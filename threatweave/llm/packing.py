"""Operator 9: hierarchical packing of documents into sequences of several lengths.

Windows have the lengths of ``TIERS``. A document first gives whole windows of the longest tier; what remains goes to the
shortest tier that holds it. Tiers are packed from long to short: the longest rest opens a window, gaps take the largest
rests that fit, from the same or a shorter tier, and where none fits one is cut. So a window is full, and only the last
one of a task stays short and is padded to the longest length: less than one window a task.

Step groups are balanced over all windows: these are numbered from the longest tier to the shortest, by prefix sums over the
counts of tiers and tasks, and dealt in turn to as many groups as the padded tokens ask for. So the groups differ by one window
of the longest tier at most.

Documents are packed where they are read, block by block: texts aren't shuffled, memory is bounded by the block, and what
doesn't fill a window waits for the next block. A task's windows are numbered from its own base (partition number times 2**40).

Defined results: a null or empty text has its end id only; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import freeing, table, written

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a block, and of a step group.
BLOCK_TOKENS = 2 << 20
STEP_TOKENS = 1 << 18
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "rank")
#: Rows (tasks times tiers) that are broadcast at most.
BROADCAST_TASKS = 1_000_000


def fill(rests: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows from ``rests`` of (length, document, start), and what is left over (less than a window)."""
    pool = sorted(rests)
    windows: list[list[tuple[int, int, int]]] = []
    while pool:
        tier = next(t for t in tiers if t >= pool[-1][0])
        window, gap, cut = [], tier, False
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:
                n, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (n - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def with_step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``pieces`` (written) with step_group instead of task and rank (a window's number among those of its task and tier)."""
    counts = pieces.filter("offset = 0").groupBy("tier", "task").agg(F.count("*").alias("n"))
    totals = {r["tier"]: r["n"] for r in counts.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    groups = max(1, round(sum(t * n for t, n in totals.items()) / step_tokens))
    longer = F.lit(0)
    for t in totals:
        longer = F.when(F.col("tier") == t, F.lit(sum(n for other, n in totals.items() if other > t))).otherwise(longer)
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tier", "task", (longer + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("base"))
    bases = written(bases, "packing-bases")
    few = bases.count() <= BROADCAST_TASKS
    placed = pieces.join(F.broadcast(bases) if few else bases, ["tier", "task"])
    return placed.select(*FIELDS[:-2], F.pmod(F.col("base") + F.col("rank"), F.lit(groups)).alias("step_group"))


def pack(docs: DataFrame, *, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document and span there, its window and offset there, the window's tier and step group."""
    longest = max(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        state = {"sequence": task << 40} | dict.fromkeys(tiers, 0)
        left: list[tuple[int, int, int]] = []
        docs: dict[int, tuple[int | None, np.ndarray]] = {}
        number = held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal left
            windows, rests = [], left
            for d, (_, ids) in docs.items():
                if d not in waiting:
                    whole = len(ids) // longest * longest
                    windows += [[(longest, d, a)] for a in range(0, whole, longest)]
                    if len(ids) > whole:
                        rests.append((len(ids) - whole, d, whole))
            more, left = fill(rests, tiers)
            windows += more
            if last and left:
                windows.append(left)
                left = []
            rows: dict[str, list] = {k: [] for k in FIELDS}
            for window in windows:
                offset, size = 0, sum(p[0] for p in window)
                tier = size if size in tiers else longest
                for n, d, start in window:
                    key, ids = docs[d]
                    row = (key, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), state["sequence"], offset, tier, task, state[tier])
                    for k, v in zip(FIELDS, row, strict=True):
                        rows[k].append(v)
                    offset += n
                state["sequence"] += 1
                state[tier] += 1
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        waiting: set[int] = set()
        for chunk in tokens.chunks(batches, "text"):
            ids, bounds = enc.encode(chunk["text"].combine_chunks())
            ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            for key, a, b in zip(chunk["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                docs[number] = (key, ids[a:b])
                number += 1
            held += len(ids)
            if held >= block_tokens:
                yield flush(False)
                # Copies, since a slice would keep the ids of its whole chunk.
                docs = {d: (docs[d][0], docs[d][1].copy()) for _, d, _ in left}
                waiting, held = set(docs), 0
        if docs:
            yield flush(True)
        tokens.forget(tokenizer_path)

    schema = pa.schema([(k, pa.int64()) for k in FIELDS])
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), ", ".join(f"{k} long" for k in FIELDS))
    return with_step_groups(written(pieces, "packing-pieces"), step_tokens)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path=tokens.default_path(), end_id=2)
