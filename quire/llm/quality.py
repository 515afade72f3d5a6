"""Quality rules: counts over the words of a text, and lines that recur across the documents of a host.

A line is hashed after folding A-Z, white space and digits. A line is boilerplate on a host if it
stands in more than `share` percent of the host's texts and in more than `least` of them. Texts are
counted by a fingerprint, a hash over all their folded lines in order, rather than by row: exact
copies count once, hence they don't make their own content boilerplate; every other text counts. A
document is depleted, and rejected, if its lines that are not boilerplate hold less than `keep`
percent of its words. Documents that stay are handed on without their boilerplate lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import _IS_SPACE, frugal, mix64, slices, utf8, windows, Words
from quire.session import cut, ship

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_FACTS = "row long, text_key long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, fingerprint long, lines array<struct<line:long,words:long>>"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of flags, how many are set between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(w: Words, h: np.ndarray) -> np.ndarray:
    """For each row the words that lie in 3-word windows found twice or more in its text."""
    s, own = windows(h, 3), w.owner()
    inside = own[2:] == own[: len(s)] if len(s) else np.zeros(0, bool)
    key = mix64(s ^ mix64(own[: len(s)].astype(np.uint64) + np.uint64(1)))
    key, at = key[inside], np.flatnonzero(inside)
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.zeros(len(key), bool)
    if len(key):
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    hit = np.zeros(len(h), bool)
    found = at[order[twin]]
    for k in range(3):
        hit[found + k] = True
    return _sums(hit, w.first)


def _lines(part: pa.Array, w: Words):
    """Lines with a word: (row, hash of the exact line, hash of its normalised words, words)."""
    data, bounds = utf8(part)
    raw = data[int(bounds[0]) : int(bounds[-1])]
    bounds = bounds - bounds[0]
    ends = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, bounds[1:]]))
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a, b = np.searchsorted(w.starts, begins), np.searchsorted(w.starts, ends)
    begins, ends, a, b = (x[b > a] for x in (begins, ends, a, b))
    row = np.searchsorted(bounds, begins, "right") - 1
    return row, begins, ends, a, b, raw


def _prefix_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs a..b of h, order included."""
    if not len(a):
        return np.zeros(0, np.uint64)
    place = np.arange(len(h), dtype=np.int64) - np.repeat(a, b - a) if len(h) == int((b - a).sum()) else None
    if place is None:  # words outside of all runs don't occur: every word lies in one line
        raise AssertionError("lines don't cover the words")
    v = mix64(h + mix64(place.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return mix64((total[b] - total[a]) ^ mix64((b - a).astype(np.uint64)))


def _facts(part: pa.Array):
    """The counts and lines of a slice of texts."""
    exact = Words(part, lower=False)
    hashes = exact.hashes()
    row, begins, ends, a, b, raw = _lines(part, exact)
    continuation = (raw & 0xC0) == 0x80
    chars = _sums(~_IS_SPACE[raw] & ~continuation, exact.bounds)
    symbols = _sums(_SYMBOL[raw], exact.bounds)

    # equal lines: the bytes between line feeds, white space included
    dup = np.zeros(len(row), bool)
    seen: set = set()
    data = raw.tobytes()
    last = -1
    for i, (r, x, y) in enumerate(zip(row.tolist(), begins.tolist(), ends.tolist())):
        if r != last:
            seen, last = set(), r
        line = data[x : y - 1] if data[y - 1] == 10 else data[x:y]
        if line in seen:
            dup[i] = True
        else:
            seen.add(line)
    dups = np.bincount(row[dup], minlength=exact.rows)

    folded = _folded_hashes(exact)
    line = _prefix_hash(folded, a, b).view(np.int64)
    return exact, chars, symbols, dups, _repeats(exact, hashes), row, line, b - a


def _folded_hashes(w: Words) -> np.ndarray:
    """Hashes of the words with A-Z folded and digits as 0."""
    kept = w.bytes
    folded = kept.copy()
    upper = (folded >= 65) & (folded <= 90)
    folded[upper] += 32
    folded[(folded >= 48) & (folded <= 57)] = 48
    w.bytes = folded
    try:
        return w.hashes()
    finally:
        w.bytes = kept


def line_facts(docs: DataFrame, host: str) -> DataFrame:
    """For each row its counts, fingerprint and distinct lines."""

    @frugal
    def run(batches):
        for batch in batches:
            ids, hosts, texts, rows, keys = (batch.column(i) for i in range(5))
            for at, part in slices(texts):
                w, chars, symbols, dups, repeats, row, line, words = _facts(part)
                bounds = np.searchsorted(row, np.arange(w.rows + 1))
                fingerprint = _prefix_hash(line.view(np.uint64), bounds[:-1], bounds[1:]).view(np.int64)
                order = np.lexsort((line, row))
                row, line, words = row[order], line[order], words[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
                starts = np.flatnonzero(first)
                total = np.add.reduceat(words, starts) if len(starts) else words[:0]
                row, line = row[starts], line[starts]
                offsets = np.searchsorted(row, np.arange(w.rows + 1))
                lines = pa.StructArray.from_arrays([pa.array(line), pa.array(total.astype(np.int64))], ["line", "words"])
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(at, w.rows), keys.slice(at, w.rows), ids.slice(at, w.rows), hosts.slice(at, w.rows)]
                    + [pa.array(np.asarray(x, np.int64)) for x in (w.counts, chars, symbols, dups, repeats, fingerprint)]
                    + [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), lines)],
                    ["row", "text_key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fingerprint", "lines"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return source.mapInArrow(run, _FACTS)


def _judged(docs: DataFrame, host: str = "source", share: int = 5, least: int = 20, keep: int = 30, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """quality() and, for each row, the hashes of its boilerplate lines as dropped (null if it has none)."""
    ship(docs.sparkSession)
    facts = cut(line_facts(docs, host))
    lines = facts.select("row", "host", "fingerprint", F.explode("lines").alias("l")).select("row", "host", "fingerprint", "l.line", "l.words")
    texts = facts.filter("n_words > 0").groupBy("host", "fingerprint").agg(F.count("*").alias("n")).groupBy("host").agg(F.count("*").alias("texts"))
    held = lines.groupBy("host", "line", "fingerprint").agg(F.count("*").alias("n")).groupBy("host", "line").agg(F.count("*").alias("n_texts"))
    common = held.filter(F.col("n_texts") > least).join(texts, "host").filter(100 * F.col("n_texts") > share * F.col("texts")).select("host", "line")
    common = cut(common)
    # a host has fewer than 100 / share times its mean lines a text of such lines; Spark broadcasts them if they are few
    lost = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("boilerplate_words"), F.collect_set("line").alias("dropped"))
    out = facts.drop("lines").join(lost, "row", "left").withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("boilerplate_words")) >= keep * F.col("n_words"))
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words", "host", "text_key", "dropped")


def quality(docs: DataFrame, host: str = "source", share: int = 5, least: int = 20, keep: int = 30, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Counts and verdict for each row of docs (doc_id, text, and the host's column).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    boilerplate_words, host and text_key (hash of the text). base_failed: fewer than `least_words` words, or more than `most_repeated` percent of
    the words in repeated 3-word windows. kept: not base_failed, and at least `keep` percent of the words outside
    of boilerplate lines. Null and empty texts have no words and fail; rows that repeat a doc_id are
    judged each for itself; rows without a host share one; an empty table gives no rows. Lines are counted
    over all documents: (host, line, fingerprint) and then (host, line), so that a line of
    every document is summed in parts before it is dealt out.
    """
    return _judged(docs, host, share, least, keep, least_words, most_repeated).drop("dropped")


def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """The texts less the lines whose hashes are dropped; the other lines as they are and in order."""
    out: list[str] = []
    for at, part in slices(texts):
        w = Words(part, lower=False)
        row, begins, ends, a, b, raw = _lines(part, w)
        line = _prefix_hash(_folded_hashes(w), a, b).view(np.int64).tolist()
        first = np.searchsorted(row, np.arange(w.rows + 1)).tolist()
        data, bounds, begins = raw.tobytes(), w.bounds.tolist(), begins.tolist()
        for i, gone in enumerate(dropped.slice(at, w.rows).to_pylist()):
            gone = set(gone)
            skip = {begins[k] for k in range(first[i], first[i + 1]) if line[k] in gone}
            kept, place = [], bounds[i]
            for x in data[bounds[i] : bounds[i + 1]].split(b"\n"):
                if place not in skip:
                    kept.append(x)
                place += len(x) + 1
            out.append(b"\n".join(kept).decode())
    return pa.array(out, pa.string())


def _texts_without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """Row by row, texts without their dropped lines; where dropped is null, the text itself."""
    texts = texts.cast(pa.string())
    hit = pc.and_(pc.is_valid(dropped), pc.is_valid(texts))
    if not pc.any(hit).as_py():
        return texts
    return pc.replace_with_mask(texts, hit, _without(texts.filter(hit), dropped.filter(hit)))


def passing(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, and their texts without boilerplate lines.

    Lines that stay are exact and in order. Where docs has n_chars, it follows the text of the rows that lose lines.
    Verdict and lines hang on host and text, so these find the rows.
    """
    verdict = _judged(docs, host, **settings).filter("not kept or dropped is not null").select("doc_id", "host", "text_key", "kept", "dropped")
    verdict = verdict.dropDuplicates(["doc_id", "host", "text_key"]).toDF("qr_id", "qr_host", "qr_key", "qr_kept", "qr_dropped")
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("qr_id"))
        & (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("qr_host"))
        & (F.xxhash64(F.col("text").cast("string")) == F.col("qr_key"))
    )
    without = F.arrow_udf(_texts_without, "string")
    out = docs.join(verdict, same, "left").filter("qr_kept is null or qr_kept")
    out = out.withColumn("text", without(F.col("text").cast("string"), F.col("qr_dropped")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("qr_dropped").isNotNull(), size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
