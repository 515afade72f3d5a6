"""Token ids in bit-packed binary files.

File, all integers little-endian: an 8-byte mark; blocks of `BLOCK` ids, each id in `bits` bits,
64 ids in `bits` 64-bit words, the last group filled with zeros; the document index (ids, a null
flag each, token counts); the byte offsets of the blocks; a fixed-size tail. A block is unpacked by
numpy shifts over all groups at once, and any range of ids is read by the offsets of its blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.files import make_dir, opened
from quire.llm.text import frugal
from quire.llm.tokens import encoder
from quire.session import cut, ship, work_path

MARK = b"QTOKBIN1"
BLOCK = 1 << 16
_TAIL = struct.Struct("<QQQQII8s")  # index offset, offsets offset, documents, tokens, bits, block, mark


def width(vocab_size: int) -> int:
    """Bits that hold every id below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each."""
    groups = -(-len(ids) // 64)
    full = np.zeros(groups * 64, np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= full[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= full[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data, as uint32."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    keep = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = v & keep
    return out.reshape(-1)[:n]


class Writer:
    """Appends documents to one file; memory is one block of ids and the document index."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.held: list[bytes] = []
        self.n_held = self.at = self.tokens = 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(MARK)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        to = len(ids) if all_of_it else len(ids) // self.block * self.block
        for i in range(0, to, self.block):
            self.offsets.append(self.at)
            self._put(pack(ids[i : min(to, i + self.block)], self.bits))
        self.held, self.n_held = [ids[to:].tobytes()], len(ids) - to

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian uint32."""
        n = len(ids) // 4
        self.docs.append((doc_id, n))
        self.held.append(ids)
        self.n_held += n
        self.tokens += n
        if self.n_held >= self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        index, n = self.at, len(self.docs)
        self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._put(np.array([d is None for d, _ in self.docs], "u1").tobytes())
        self._put(np.array([c for _, c in self.docs], "<u8").tobytes())
        offsets = self.at
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(_TAIL.pack(index, offsets, n, self.tokens, self.bits, self.block, MARK))


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        index, offsets, self.n_docs, self.n_tokens, self.bits, self.block, mark = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if mark != MARK:
            raise ValueError(f"{uri} is no token file")
        self.end, n = index, self.n_docs
        raw = self._at(index, n * 17)
        ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.counts = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(self._at(offsets, size - _TAIL.size - offsets), "<u8").astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the file; only their blocks are read."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block
        out = []
        for k in range(a, b + 1):
            to = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.end
            there = min(self.block, self.n_tokens - k * self.block)
            out.append(unpack(self._at(int(self.offsets[k]), int(to - self.offsets[k])), there, self.bits))
        return np.concatenate(out)[start - a * self.block : start - a * self.block + n]

    def documents(self):
        """(doc_id, ids) in file order, a run of blocks at a time."""
        at, begin, ids = 0, 0, np.zeros(0, np.uint32)
        for d, n in zip(self.doc_ids, self.counts.tolist()):
            if at + n > begin + len(ids):
                begin, ids = at, self.ids(at, max(n, min(self.block * 4, self.n_tokens - at)))
            yield d, ids[at - begin : at - begin + n]
            at += n


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the ids of each text and end_id to bit-packed files, in ascending doc_id.

    Texts are dealt out by ranges of doc_id and one task writes one file; rows that repeat a doc_id
    go by text, null ids first. Null and empty texts give end_id alone. A file's name holds a random part, so that
    a task that runs again after a loss leaves no mixed file; the returned manifest (shard, path,
    documents, tokens, first: ids in the shards before it) names the files that count. An empty
    table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or work_path(spark, "tokens")
    make_dir(folder)

    def run(batches):
        writer = stream = None
        path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.qtb"
        enc = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1))):
                if writer is None:
                    system, place = opened(path)
                    stream = system.open_output_stream(place)
                    writer = Writer(stream, width(max(enc.vocab_size, end_id + 1)))
                writer.add(d, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": path, "documents": len(writer.docs), "tokens": writer.tokens}])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(rows.mapInArrow(frugal(run), "shard long, path string, documents long, tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """From the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    ship(manifest.sparkSession)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["first"], []
                for d, ids in Reader(row["path"]).documents():
                    out.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())  # so many tasks: the rows are small, the files are not
    return manifest.select("path", "first").repartition(files, "path").mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
