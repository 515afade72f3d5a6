"""Packing of token streams into fixed-length sequences by order-preserving dynamic programming.

Documents stay in order and the stream is cut into windows of at most `capacity` tokens. Cuts are
allowed at document ends, at sentence ends and, inside stretches without either, every few tokens.
With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + capacity - j + min over i in [j - capacity, j) of (f(i) + i)

so a monotone queue of f(i) + i gives each minimum in constant time.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import frugal, hand_back
from quire.llm.tokens import encoder
from quire.session import cut, ship, small_batches

#: Cost, in tokens of padding, of a cut at a sentence end and of a cut inside a sentence.
SENTENCE_CUT, INNER_CUT = 8, 64
#: A stretch without sentence end longer than this may be cut every INNER_STEP tokens.
LONGEST_STRETCH, INNER_STEP = 512, 128
#: Windows that one run of the dynamic program covers; bounds the memory of a task.
RUN_WINDOWS = 256
#: Remainders of so many tasks are packed together.
TAILS_TOGETHER = 512

_PIECE = "sequence_id long, offset long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, tail boolean"
_FIELDS = ["sequence_id", "offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "tail"]


def best_cuts(places: list[int], penalties: list[int], capacity: int, closed: bool) -> list[int]:
    """Cuts of least cost. places: ascending from 0, the last is the end of the stream; no step exceeds capacity.

    closed: the last window is padded too; else it stays open and costs nothing.
    """
    n = len(places)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, i), ascending
    last = n - 1
    for j in range(1, n):
        at = places[j]
        while places[queue[0][1]] < at - capacity:
            queue.popleft()
        if j == last and not closed:
            i = min((i for _, i in queue), key=lambda i: (cost[i], -i))
            back[j] = i
            break
        key, i = queue[0]
        c = key + capacity - at + penalties[j]
        cost[j], back[j] = c, i
        key = c + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out = []
    while last:
        out.append(places[last])
        last = back[last]
    return out[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[list[int], list[int]]:
    """Places where the stream may be cut and their penalties; doc_ends ascending, up to len(ids)."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int16)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    places = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(places) > LONGEST_STRETCH):
        inner = np.arange(places[i] + INNER_STEP, places[i + 1], INNER_STEP)
        penalty[inner] = INNER_CUT
    places = np.flatnonzero(penalty >= 0)
    return places.tolist(), penalty[places].tolist()


class Packer:
    """Packs documents that come in order; holds about RUN_WINDOWS windows."""

    def __init__(self, capacity: int, sentence_end: np.ndarray, keep_ids: bool):
        self.capacity, self.sentence_end, self.keep_ids = capacity, sentence_end, keep_ids
        self.parts: list[tuple[int | None, int, int, bytes]] = []  # doc_id, tokens of the document, where this part begins, ids
        self.held = self.sequence = 0

    def add(self, doc_id: int | None, doc_tokens: int, start: int, ids: bytes):
        """A document or the rest of one; yields the rows of windows that are settled."""
        self.parts.append((doc_id, doc_tokens, start, ids))
        self.held += len(ids) // 4
        if self.held >= self.capacity * RUN_WINDOWS:
            yield from self._settle(False)

    def _settle(self, final: bool):
        raw = b"".join(p[3] for p in self.parts)
        ids = np.frombuffer(raw, "<u4")
        sizes = np.array([len(p[3]) // 4 for p in self.parts])
        ends = np.cumsum(sizes)
        # the last document may go on in no other part, so every part but a cut one ends its document
        places, penalties = allowed_cuts(ids, ends, self.sentence_end)
        cuts = best_cuts(places, penalties, self.capacity, final)
        if final:
            cuts = cuts[:-1] + _powers(cuts[-2] if len(cuts) > 1 else 0, len(ids), self.capacity)
        else:
            cuts = cuts[:-1]
        done = cuts[-1] if cuts else 0
        begins = ends - sizes
        bounds = np.array([0, *cuts])
        edges = np.unique(np.concatenate([bounds, begins[begins < done]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            k = int(np.searchsorted(begins, a, "right")) - 1
            w = int(np.searchsorted(bounds, a, "right")) - 1
            doc_id, tokens, start, _ = self.parts[k]
            piece = raw[4 * a : 4 * b]
            yield (self.sequence + w, a - int(bounds[w]), doc_id, start + a - int(begins[k]), b - a, zlib.crc32(piece), tokens, piece if self.keep_ids else None, False)
        self.sequence += len(cuts)
        k = int(np.searchsorted(ends, done, "right"))
        rest = self.parts[k:]
        if rest and begins[k] < done:
            doc_id, tokens, start, part = rest[0]
            skip = done - int(begins[k])
            rest[0] = (doc_id, tokens, start + skip, part[4 * skip :])
        self.parts, self.held = rest, len(ids) - done

    def finish(self):
        """Rows of all that is left, the last window included."""
        if self.held:
            yield from self._settle(True)

    def remainder(self):
        """Rows of settled windows; then the parts of the last, open window as rows marked tail."""
        if self.held:
            yield from self._settle(False)
        for k, (doc_id, tokens, start, ids) in enumerate(self.parts):
            yield (None, k, doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, ids, True)


def _powers(begin: int, end: int, capacity: int) -> list[int]:
    """Cuts of the last window into powers of two, which need no padding, where that costs less than the padding."""
    n = end - begin
    if n & (n - 1) == 0 or capacity - n <= INNER_CUT * (n.bit_count() - 1):
        return [end]
    out = []
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            begin += 1 << k
            out.append(begin)
    return out


@functools.cache
def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id whether it ends a sentence: a token of punctuation that ends in . ! or ?"""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(encoder(tokenizer).vocab_size, max(vocab.values()) + 1), bool)
    for token, i in vocab.items():
        bare = token.removesuffix("</w>")
        out[i] = bare[-1:] in (".", "!", "?") and not any(c.isalnum() for c in bare)
    return out


def _batches(rows, size: int = 4096):
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows):
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _FIELDS)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens.

    docs: doc_id, text; a document is the ids of its text and end_id; null or empty text is end_id
    alone, and rows that repeat a doc_id are documents of their own. Texts are dealt out by ranges of
    doc_id, each task packs its stream, and the open last windows of up to 512 tasks are packed
    together by the same program; what then remains is cut into powers of two, which need no padding, if
    that costs less. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    ids (little-endian uint32) with keep_ids. sequence_id is unique, not dense. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        packer = None
        end = np.array([end_id], "<u4").tobytes()

        def rows():
            nonlocal packer
            enc = encoder(tokenizer)
            for batch in batches:
                packer = packer or Packer(capacity, _fits(sentence_ends(tokenizer), end_id), keep_ids)
                for d, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1))):
                    ids += end
                    yield from packer.add(d, len(ids) // 4, 0, ids)
                hand_back()
            if packer:
                yield from packer.remainder()

        yield from _batches((shard if r[8] else shard + r[0], *r[1:]) for r in rows())

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(spark):
        pieces = cut(source.mapInArrow(frugal(run), _PIECE))
    tails = pieces.filter("tail").withColumn("together", F.shiftright("sequence_id", 32) / TAILS_TOGETHER)

    def join_tails(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(capacity, _fits(sentence_ends(tokenizer), end_id), keep_ids)
        base = 1 << 62 | int(key[0].as_py()) << 32
        found = []
        for r in table.to_pylist():
            found += packer.add(r["doc_id"], r["doc_tokens"], r["start"], r["ids"])
        found += packer.finish()
        return pa.Table.from_batches(list(_batches((base + r[0], *r[1:]) for r in found)))

    tails = tails.withColumn("together", F.floor("together").cast("long"))
    tails = tails.groupBy("together").applyInArrow(join_tails, _PIECE)
    out = pieces.filter("not tail").unionByName(tails)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*columns, *["ids"] * keep_ids)


def _fits(ends: np.ndarray, end_id: int) -> np.ndarray:
    """The lookup reaches end_id too."""
    return ends if end_id < len(ends) else np.concatenate([ends, np.zeros(end_id + 1 - len(ends), bool)])
