"""Best-fit packing planned on a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.storage import materialize, table
from quillon.llm.tokens import broadcast_file, encoder

CAPACITY = 2048
END_ID = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only longer ones are cut; all pieces but the first are full."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths; returns the slots and the number of sequences.

    A slot (length, rank, sequence, offset, each) says: the pieces of that length from rank on fill sequences from
    `sequence` on, `each` of them per sequence, beginning at `offset`. It holds up to the next slot of that length.
    Sequences with the same room left are kept as ranges, so the work and the plan depend on the number of lengths
    and not on that of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, number)
    rooms: list[int] = []
    slots, used = [], 0

    def leave(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                space = rooms[i]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], rooms[i]
            else:
                space, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            each = space // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, first, capacity - space, each))
                leave(space - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if left and number:
                slots.append((length, rank, first, capacity - space, left))
                leave(space - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            leave(space, first, number)
    return slots, used


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, __chunk, __rank and, if wanted, ids.

    A null text is empty, and so the single end id. __rank numbers the pieces of one length within a task's rows
    (__chunk), as they pass: no rows are gathered.
    """
    file = broadcast_file(docs.sparkSession, path)

    def tokenise(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, chunk, seen = encoder(file.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "__chunk", "__rank")}
                kept = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.asarray([*encode(text or ""), END_ID], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rank = seen[length] = seen.get(length, -1) + 1
                        for name, x in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), chunk, rank), strict=True):
                            out[name].append(x)
                        if with_ids:
                            kept.append(own.astype("int32"))
                columns = [pa.array(out["doc_id"], type=batch.schema.field(0).type), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")), pa.array(out["__chunk"], pa.int32()), pa.array(out["__rank"], pa.int64())]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*out, *["ids"] * with_ids])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, __chunk int, __rank long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tokenise, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids.

    docs needs doc_id and text (null: empty); repeated rows are packed each; an empty table gives no rows. The driver
    sees a count for each length (at most `capacity`) and sends the plan back, whose size depends on the lengths too.
    A piece's rank within its length is its rank within its task's rows plus the count of that length in the tasks
    before, so that no length, however common, is gathered in one place.
    """
    pieces = materialize(token_pieces(docs, path, capacity, with_ids), "pieces")
    per = pieces.groupBy("__chunk", "length").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    slots, _ = plan(counts, capacity)
    slots.sort()
    plan_sent = docs.sparkSession.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col("__chunk").alias("__c"), F.col("length").alias("__l"), "__before")
    ranked = pieces.join(per, (F.col("__chunk") == F.col("__c")) & (F.col("length") == F.col("__l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).alias("__rank"), *["ids"] * with_ids)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        table_ = np.array(plan_sent.value, dtype=np.int64).reshape(-1, 5)
        step = np.int64(1) << 48  # ranks stay below
        starts = table_[:, 0] * step + table_[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            slot = table_[np.searchsorted(starts, length * step + rank, side="right") - 1] if len(length) else table_[:0]
            inside = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + inside // slot[:, 4], slot[:, 3] + inside % slot[:, 4] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset), *(batch.column(batch.schema.get_field_index(c)) for c in ["ids"] * with_ids)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset", *["ids"] * with_ids])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
