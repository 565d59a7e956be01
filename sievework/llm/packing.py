"""Best-fit packing of token pieces into sequences, planned over the histogram of piece lengths.

A document is its ids and the end id. One longer than the sequence is cut into pieces of full length, of
which the first may be shorter; others stay whole. Best fit runs over the counts per length (at most seq_len
numbers, whatever the corpus), longest first, and places runs of equal pieces at once. Each placement is a
slot range (length, ranks) -> (sequence, offset); a piece takes the slot of its rank among the pieces of its
length. Ranks are counted per task while encoding and shifted by the counts of the tasks before, so no
length, however common, meets in one place.

Rows: a null text counts as empty, so its document is the end id alone; a null doc_id is kept; repeated rows
are separate documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.encoding import encoder, pieces, slices
from sievework.runtime import cut

MAX_SLOTS = 200_000


def token_pieces(docs: DataFrame, vocabulary: str, *, end_id: int = 2, seq_len: int = 1024, keep_space: bool = True, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, task_rank[, ids]); ids are little-endian unsigned 32-bit."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task, end = encoder(vocabulary, keep_space), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        ranks = [0] * (seq_len + 1)
        for batch in pieces(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "ids")}
                for key, ids in zip(keys[a:b], enc.encode(texts[a:b])):
                    ids += end
                    n = len(ids) // 4
                    at = i = 0
                    while at < n:
                        size = (n - at - 1) % seq_len + 1
                        raw = ids[4 * at : 4 * (at + size)]
                        rows["doc_id"].append(key)
                        rows["piece"].append(i)
                        rows["start"].append(at)
                        rows["length"].append(size)
                        rows["ids_crc32"].append(zlib.crc32(raw))
                        rows["task_rank"].append(ranks[size])
                        if with_ids:
                            rows["ids"].append(raw)
                        ranks[size] += 1
                        at, i = at + size, i + 1
                n = len(rows["doc_id"])
                cols = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["ids_crc32"], pa.int64()), pa.array([task] * n, pa.int64()), pa.array(rows["task_rank"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(rows["ids"], pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def plan_slots(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, end rank, first sequence, offset)."""
    room: dict[int, list[tuple[int, int]]] = {}  # by tokens left: runs of sequences (first, how many)
    slots, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left:
            room.setdefault(left, []).append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = min((r for r in room if r >= length), default=None)
            if left is None:
                per = seq_len // length
                for n, each in ((todo // per, per), (1, todo % per)):
                    if n and each:
                        for k in range(each):
                            slots.append((length, rank, rank + n, opened, k * length))
                            rank += n
                        put(seq_len - each * length, opened, n)
                        opened += n
                break
            first, n = room[left].pop()
            if not room[left]:
                del room[left]
            take = min(n, todo)
            slots.append((length, rank, rank + take, first, seq_len - left))
            put(left - length, first, take)
            if take < n:
                put(left, first + take, n - take)
            rank, todo = rank + take, todo - take
    return slots


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 2, seq_len: int = 1024, keep_space: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset.

    The pieces are written once to the shared folder, for their ranks to hold. The driver gets the counts per
    length (seq_len rows at most) and sends back the slot ranges: up to MAX_SLOTS by broadcast, more as a table to join.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, end_id=end_id, seq_len=seq_len, keep_space=keep_space, with_ids=with_ids))
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    slots = plan_slots(counts, seq_len)
    planned = spark.createDataFrame(slots, "slot_length long, first long, end long, sequence long, at long").coalesce(1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = by_task.select("task", "length", before.alias("shift"))
    ranked = pieces.join(shifts, ["task", "length"]).withColumn("rank", F.col("task_rank") + F.col("shift"))
    placed = ranked.join(F.broadcast(planned) if len(slots) <= MAX_SLOTS else planned, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    out = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("at").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from pack(..., with_ids=True): sequence_id, length, doc_ids and ids in order."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
