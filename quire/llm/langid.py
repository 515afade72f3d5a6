"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary; white space ends a word and no piece crosses it.
For each language every piece has a probability, and the likelihood of a word is the sum over all
ways to write it as pieces, by the forward recursion over its bytes:

    a(0) = 1,   a(i) = sum over pieces p that end at byte i of P(p) * a(i - len(p))

Each single byte is a piece too, so no word is impossible. A word's letters A-Z are folded, and
the sum of a text is the product over its words, whole texts throughout. The probabilities start from equal ones and are
fitted by expectation maximisation (forward and backward sums) on word counts of a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quire.llm.text import frugal, mix64, slices, Words
from quire.session import ship

#: Words of more bytes are not learned from; they are scored whole like all others.
LONGEST_LEARNED = 4096
UNKNOWN = "und"

#: Sums below this are scaled up by its inverse; a sum of logarithms keeps account.
_SMALL = 1e-60
#: End positions by words that one segment of the recursion covers; bounds the tables of a step.
_CELLS = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def vocabulary(model: str) -> list[bytes]:
    """Byte strings of the pieces of a sentencepiece file, without the mark of a word's begin; single bytes first."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {bytes([b]) for b in range(256)}
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)):
            piece = p.id_to_piece(i).replace("▁", "").lower().encode()
            if piece:
                found.add(piece)
    return sorted(found, key=lambda x: (len(x), x))


class Lattice:
    """Finds the pieces in many words at once and runs the recursions over all of them.

    Every prefix of a piece is known by a 64-bit hash, so a search from a byte goes on only while some
    piece begins so; its length is that of the longest piece there.
    """

    def __init__(self, pieces: list[bytes]):
        lengths = np.array([len(p) for p in pieces])
        self.longest = int(lengths.max())
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        h, live, keys, ids = np.zeros(len(pieces), np.uint64), np.arange(len(pieces)), [], []
        for m in range(self.longest):
            live = live[lengths[live] > m]
            h[live] = h[live] * _BASE + data[first[live] + m] + _U(1)
            keys.append(h[live])
            ids.append(np.where(lengths[live] == m + 1, live, -1))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((-ids, keys))  # of equal prefixes the one that is a piece
        keys, ids = keys[order], ids[order]
        only = np.concatenate([[True], keys[1:] != keys[:-1]])
        keys, ids = keys[only], ids[only]
        bits = (len(keys) * 4 - 1).bit_length()
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        # open addressing with linear steps: of those that want a free place the first gets it, the others step on
        self.table_key, self.table_id = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        at, left, self.steps = (keys * _BASE >> self.shift).astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            free = left[self.table_id[at[left]] == -2]
            _, nth = np.unique(at[free], return_index=True)
            won = free[nth]
            self.table_key[at[won]], self.table_id[at[won]] = keys[won], ids[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.steps += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, -1 for the begin of a piece, -2 for neither."""
        at = (keys * _BASE >> self.shift).astype(np.int64)
        out = self.table_id[at]
        miss = np.flatnonzero((self.table_key[at] != keys) & (out != -2))
        out[miss] = -2
        at = (at[miss] + 1) & self.mask
        for _ in range(self.steps - 1):
            if not len(miss):
                break
            here = self.table_id[at]
            hit = (self.table_key[at] == keys[miss]) & (here != -2)
            out[miss[hit]] = here[hit]
            on = ~hit & (here != -2)
            miss, at = miss[on], (at[on] + 1) & self.mask
        return out

    def arcs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: int, high: int):
        """Pieces in the words that end after `low` and not after `high`, by end and word: (end, word, bytes, piece)."""
        begin = max(0, low - self.longest + 1)
        n = np.clip(lengths, 0, high) - begin
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), np.maximum(n, 0))
        n = np.maximum(n, 0)
        place = begin + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(lengths, high)[word]
        h, found = np.zeros(len(word), np.uint64), []
        for m in range(1, self.longest + 1):
            on = place + m <= last
            if not on.all():
                word, place, last, h = word[on], place[on], last[on], h[on]
            if not len(word):
                break
            h = h * _BASE + data[starts[word] + place + (m - 1)] + _U(1)
            piece = self.find(h)
            hit = (piece >= 0) & (place + m > low)
            found.append((place[hit] + m, word[hit], np.full(int(hit.sum()), m, np.int32), piece[hit]))
            on = piece != -2
            word, place, last, h = word[on], place[on], last[on], h[on]
        end, word, m, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((word, end))
        return end[order], word[order], m[order], piece[order]

    def forward(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word by language: words as bytes from starts on, p as pieces by languages.

        A segment of end positions is worked at a time, and the sums at its last ends are carried over; sums are
        scaled as they get small, so words may have any length.
        """
        n, back = len(lengths), self.longest
        out, scale = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
        carried = np.zeros((back, n, p.shape[1]))
        carried[-1] = 1.0
        width, step = int(lengths.max(initial=0)), max(64, _CELLS // max(1, n))
        for low in range(0, width, step):
            high = min(width, low + step)
            end, word, m, piece = self.arcs(data, starts, lengths, low, high)
            a = np.concatenate([carried, np.zeros((high - low, n, p.shape[1]))])
            bounds = np.searchsorted(end, np.arange(low + 1, high + 2))
            for k in range(high - low):
                x, y = bounds[k], bounds[k + 1]
                if x == y:
                    break
                row, who = back + k, word[x:y]
                flow = a[row - m[x:y], who] * p[piece[x:y]]
                edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                who, flow = who[edges], np.add.reduceat(flow, edges)
                small = flow < _SMALL
                if small.any():
                    up = np.where(small, 1 / _SMALL, 1.0)
                    flow = flow * up
                    a[row - back + 1 : row, who] *= up
                    scale[who] -= np.log(up)
                a[row, who] = flow
                done = lengths[who] == low + k + 1
                out[who[done]] = np.log(flow[done]) + scale[who[done]]
            carried = a[-back:]
        return out

    def expected(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each counted so many times, under the probabilities p of one language."""
        n, width = len(lengths), int(lengths.max())
        end, word, m, piece = self.arcs(data, starts, lengths, 0, width)
        bounds = np.searchsorted(end, np.arange(1, width + 2))
        a, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        up_a, up_b = np.zeros((width + 1, n)), np.zeros((width + 1, n))  # logarithms of what the sums are scaled by
        a[0] = 1.0
        for e in range(1, width + 1):
            x, y = bounds[e - 1], bounds[e]
            who, before = word[x:y], e - m[x:y]
            top = up_a[e - 1, who]
            flow = a[before, who] * np.exp(top - up_a[before, who]) * p[piece[x:y]]
            edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            total, who = np.add.reduceat(flow, edges), who[edges]
            a[e, who], up_a[e, who] = 1.0, up_a[e - 1, who] - np.log(total)
        b[lengths, np.arange(n)] = 1.0
        uses = np.zeros(len(p))
        for e in range(width, 0, -1):
            x, y = bounds[e - 1], bounds[e]
            who, before = word[x:y], e - m[x:y]
            # sums from e to the end, scaled so that a sum over all pieces that begin at a byte is known only when all are added
            flow = p[piece[x:y]] * b[e, who]
            fresh = b[before, who] == 0
            up_b[before[fresh], who[fresh]] = up_b[e, who[fresh]]
            b[before, who] += flow * np.exp(up_b[before, who] - up_b[e, who])
            # a(before) * P * b(e) / a(length)
            share = flow * np.exp(up_a[lengths[who], who] - up_a[before, who] - up_b[e, who])
            uses += np.bincount(piece[x:y], weights=share * times[who], minlength=len(p))
            here = e - 1
            if here:
                small = (b[here] > 0) & (b[here] < _SMALL)
                if small.any():
                    b[here, small] /= _SMALL
                    up_b[here, small] -= np.log(_SMALL)
        return uses


def distinct_words(part: pa.Array):
    """Distinct words of a slice: (bytes, starts, lengths, word of each occurrence, row of each occurrence, rows)."""
    w = Words(part)
    lengths = w.ends - w.starts
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return w.bytes, w.starts[first], lengths[first], which, w.owner(), w.rows


def _by_length(lengths: np.ndarray, limit: int = 8_000):
    """Indices of words of like length, at most `limit` a step and fewer of long ones."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        shortest = int(lengths[order[at]])
        top = max(4, shortest + shortest // 3)
        to = min(at + max(1, min(limit, 16 * limit // max(1, top))), int(np.searchsorted(lengths[order], top, "right")))
        yield order[at:to]
        at = to


class Model:
    """Languages, pieces and the probabilities of pieces by language."""

    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self._lattice = None

    def __getstate__(self):
        return (self.languages, self.pieces, self.p)

    def __setstate__(self, state):
        self.languages, self.pieces, self.p = state
        self._lattice = None

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def log_likelihood(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the words of each text of the log of their likelihood by language, and the number of words."""
        data, starts, lengths, which, own, rows = distinct_words(part)
        scores = np.zeros((len(starts), len(self.languages)))
        for at in _by_length(lengths):
            scores[at] = self.lattice.forward(data, starts[at], lengths[at], self.p)
        out = np.stack([np.bincount(own, weights=scores[which, k], minlength=rows) for k in range(len(self.languages))], 1) if len(own) else np.zeros((rows, len(self.languages)))
        return out, np.bincount(own, minlength=rows)


def fit(counts: pa.Table | dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4, least: float = 0.05) -> Model:
    """Piece probabilities by expectation maximisation. counts: a table of lang, word (binary), n, or language -> word -> times."""
    if isinstance(counts, dict):
        rows = [(lang, w, n) for lang in counts for w, n in counts[lang].items()]
        counts = pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])
    languages = sorted(pc.unique(counts["lang"]).to_pylist())
    lattice = Lattice(pieces)
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for k, lang in enumerate(languages):
        rows = counts.filter(pc.equal(counts["lang"], lang)).sort_by("word").combine_chunks()  # the same model whatever the order of the rows
        words = rows["word"].combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data, times, lengths = np.frombuffer(words.buffers()[2] or b"", np.uint8), rows["n"].to_numpy().astype(float), np.diff(bounds)
        some = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_LEARNED))
        starts, times, lengths = bounds[:-1][some], times[some], lengths[some]
        for _ in range(rounds):
            uses = np.full(len(pieces), least)
            for at in _by_length(lengths):
                uses += lattice.expected(data, starts[at], lengths[at], times[at], p[:, k])
            p[:, k] = uses / uses.sum()
    return Model(languages, pieces, p)


def sample(docs: DataFrame, lang: str, per_language: int) -> DataFrame:
    """About per_language labelled rows of each language, by hash of doc_id and text, as (lang, text)."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    rate = F.lit(0.0)
    for k, v in n.items():
        rate = F.when(F.col(lang) == k, min(1.0, per_language / v)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(3)), F.lit(1 << 30)) < rate * (1 << 30)
    return rows.filter(draw).select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def learn(docs: DataFrame, pieces: list[bytes], lang: str = "lang", per_language: int = 1500) -> Model:
    """Fit a model on a sample of docs: about `per_language` rows of each language, whatever the size of docs.

    Texts in the sample count with all their words of up to LONGEST_LEARNED bytes. Rows without text or label are not
    learned from; labels of null doc_id count like others; of a table without labels nothing is learned.
    """
    rows = sample(docs, lang, per_language)
    word = F.explode(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    counted = rows.select("lang", word.alias("word")).filter(F.octet_length("word") <= LONGEST_LEARNED).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return fit(counted.select("lang", F.col("word").cast("binary").alias("word"), "n").toArrow(), pieces)  # the words of the sample


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with lang_pred and score, from the whole text alone; columns of these names are replaced.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if the model has learned no language.
    score is the share of the predicted language among all when each gets the geometric mean likelihood of a word. Ties
    go to the first language by name. Each row is predicted for itself; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    names = np.array([*model.languages, UNKNOWN], object)

    @frugal
    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            for at, part in slices(batch.column(1)):
                lettered = np.array([t is not None and letter(t) is not None for t in part.to_pylist()])
                pred, score = np.full(len(part), len(model.languages)), np.zeros(len(part))
                if model.languages:
                    total, n = model.log_likelihood(part)
                    total = total / np.maximum(n, 1)[:, None]
                    share = np.exp(total - total.max(1, keepdims=True))
                    share /= share.sum(1, keepdims=True)
                    pred = np.where(lettered, share.argmax(1), pred)
                    score = np.where(lettered, share.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], ["r", "lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*own).alias("r"), F.col("text").cast("string"))
    out = StructType([rows.schema["r"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, out).select("r.*", "lang_pred", "score")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text); see tagged()."""
    return tagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")
