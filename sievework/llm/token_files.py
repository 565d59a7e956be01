"""Token-ID output: Arrow IPC files of equal-length sequences, with random access without copying.

A part holds the token stream of a range of documents. NAME.arrow is an Arrow file whose columns `ids`
(fixed-size list of uint16, or uint32 for vocabularies over 65,536) and `mask` (fixed-size list of bits) hold the
stream cut into sequences of seq_len; only the part's last sequence is padded (id 0, mask 0). Every record batch but the last has
BATCH sequences, so sequence i is row i % BATCH of batch i // BATCH and a memory map serves it in place.
NAME.docs.arrow lists the part's documents: doc_id, offset in the part's stream, n_tokens.

Rows: a null text counts as empty (its document is the end id alone), a null doc_id sorts first, equal
doc_ids are ordered by a hash of their text, repeated rows are written as often as they come, other columns
are ignored, and an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.encoding import encoder, pieces, slices
from sievework.runtime import cut, new_folder

BATCH = 256
MANIFEST = "part long, file string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = 2, seq_len: int = 2048, keep_space: bool = False) -> DataFrame:
    """Encode whole texts, append end_id, and write the stream in ascending doc_id order; returns the manifest.

    Documents are dealt by ranges of doc_id and text hash, so parts follow each other in order and none holds more than
    its share, even of rows without an id. A task streams its rows into a file of its own name and moves it into place when
    complete: a task run again after a lost executor replaces it with the same bytes, and what it had begun is removed.
    """
    from pyarrow import fs

    def write(batches):
        import os
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        enc, part, end = encoder(vocabulary, keep_space), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}"
        temp = f"{root}/.{name}-{uuid.uuid4().hex}"
        kind = np.uint16 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        lists = {"ids": pa.list_(pa.from_numpy_dtype(kind), seq_len), "mask": pa.list_(pa.bool_(), seq_len)}
        sinks, writers = [], []

        def begin():
            store.create_dir(root, recursive=True)
            for suffix, schema in ((".arrow", pa.schema(lists)), (".docs.arrow", pa.schema({"doc_id": pa.int64(), "offset": pa.int64(), "n_tokens": pa.int64()}))):
                sinks.append(store.open_output_stream(temp + suffix))
                writers.append(pa.ipc.new_file(sinks[-1], schema))

        def put(raw: bytes, real: int):
            ids = pa.array(np.frombuffer(raw, "<u4").astype(kind))
            mask = np.arange(len(ids)) < real
            writers[0].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(ids, seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)], names=["ids", "mask"]))

        held, total, n_docs, full = bytearray(), 0, 0, BATCH * seq_len * 4
        for batch in pieces(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                if not writers:
                    begin()
                offsets, counts = [], []
                for ids in enc.encode(texts[a:b]):
                    held += ids
                    held += end
                    offsets.append(total)
                    counts.append(len(ids) // 4 + 1)
                    total += counts[-1]
                while len(held) >= full:
                    put(bytes(held[:full]), full // 4)
                    del held[:full]
                writers[1].write_batch(pa.record_batch([keys.slice(a, b - a).cast(pa.int64()), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "offset", "n_tokens"]))
                n_docs += b - a
        if not writers:
            return
        if held:
            real = len(held) // 4
            put(bytes(held) + bytes(-len(held) % (seq_len * 4)), real)
        for w, s in zip(writers, sinks):
            w.close()
            s.close()
        for suffix in (".arrow", ".docs.arrow"):
            store.move(temp + suffix, f"{root}/{name}{suffix}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_tokens": [total]})

    order = ["doc_id", F.xxhash64("text")]
    manifest = cut(docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST))
    store, root = fs.FileSystem.from_uri(folder)
    for left in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if left.base_name.startswith("."):  # of attempts that did not end
            store.delete_file(left.path)
    return manifest


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start in the whole stream, n_tokens, ids_crc32.

    Only the manifest, one row per part, is ordered in one place, to add up the parts before each.
    """

    def read(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        local = isinstance(store, fs.LocalFileSystem)

        def opened(path):
            return pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                index, stream = opened(f"{root}/{name}.docs.arrow"), opened(f"{root}/{name}.arrow")
                seq_len = stream.schema.field("ids").type.list_size
                per_batch, at, view = BATCH * seq_len, -1, None
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    offsets, counts, crcs = b.column(1).to_numpy(), b.column(2).to_numpy(), []
                    for o, n in zip(offsets.tolist(), counts.tolist()):
                        crc = 0
                        while n:
                            if o // per_batch != at:
                                at = o // per_batch
                                view = stream.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True).astype("<u4", copy=False)
                            piece = view[o % per_batch : o % per_batch + n]
                            crc = zlib.crc32(piece, crc)
                            o, n = o + len(piece), n - len(piece)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(offsets + base), b.column(2), pa.array(np.array(crcs, np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("file", before.alias("base"))
    return parts.repartition(max(1, manifest.count())).mapInArrow(read, DOCS)


def sequence(folder: str, name: str, i: int):
    """Sequence i of a part as a read-only view of the mapped file, and its mask."""
    import pyarrow as pa
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.arrow"
    stream = pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))
    b = stream.get_batch(i // BATCH)
    ids, mask = (b.column(c)[i % BATCH].values for c in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def token_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, *, end_id: int = 2, seq_len: int = 2048) -> DataFrame:
    """Write the files to a new shared folder and read every document back from them."""
    folder = new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, folder, end_id=end_id, seq_len=seq_len), folder)
