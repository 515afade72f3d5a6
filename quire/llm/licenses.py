"""License scan: MinHash bands over overlapping windows find templates, exact containment decides.

Words are runs of letters and digits, folded, every digit as 0; shingles take five words. Templates
and texts are cut into overlapping windows of a few fixed sizes. A window's signature holds
`bands * ROWS` minima; a text window that shares a band with a template window makes that template
a candidate for the text. Windows don't run over the end of a text: past it they are cut off. Text windows begin every quarter of their size, so some window is off
by at most an eighth; with a fifth of the shingles changed the similarity is then still about
0.5, and 24 bands of 2 rows meet it with probability 1 - (1 - 0.5^2)^24 > 0.998. A candidate
is a match where a stretch of the text, up to a quarter longer than the template, contains at least
80 percent of the template's distinct shingles. As digits are folded, a match of a name with a version
keeps the version only if the template's numbers stand in the stretch in order.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.license_texts import TEMPLATES
from quire.llm.text import frugal, mix64, slices, windows, Words
from quire.session import ship

SHINGLE, ROWS, BANDS, PERCENT = 5, 2, 24, 80
#: Sizes of windows in shingles; a template is cut by the largest that it fills.
SIZES = (1, 3, 8, 24)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def _minima(h: np.ndarray, size: int, n: int, at: np.ndarray) -> np.ndarray:
    """n minima of each window of `size` shingle hashes that begins at a place of `at`; the hash 0 stands for none."""
    rng = np.random.default_rng(17)
    a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n, np.uint32)
    short, none = (h ^ (h >> np.uint64(32))).astype(np.uint32), h == 0
    count = len(h) - size + 1
    out = np.empty((n, len(at)), np.uint32)
    for i in range(n):
        m, w = (short ^ b[i]) * a[i], 1
        m[none] = np.uint32(0xFFFFFFFF)
        while 2 * w <= size:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < size:
            m = np.minimum(m[:count], m[size - w :])
        out[i] = m[at]
    return out


def _apart_from_all(starts: list[int], stretches: list[tuple[int, int]], x: int, y: int) -> bool:
    """Put x..y among sorted disjoint stretches unless it overlaps one; says whether it went in."""
    k = bisect.bisect_right(starts, x)
    if (k and stretches[k - 1][1] >= x) or (k < len(starts) and starts[k] <= y):
        return False
    starts.insert(k, x)
    stretches.insert(k, (x, y))
    return True


def _band_keys(minima: np.ndarray, size: int):
    """Keys of the bands, one array a band."""
    for k in range(len(minima) // ROWS):
        key = np.full(minima.shape[1], size * 1000 + k + 1, np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[k * ROWS + r])
        yield key


class Index:
    """Band keys of all template windows, and the templates' shingles."""

    def __init__(self, templates=tuple(TEMPLATES), bands: int = BANDS):
        self.bands = bands
        words = Words(pa.array([t for _, t in templates]), table=_FOLD)
        h = words.hashes()
        keys: dict[int, set[int]] = {}
        self.names, self.numbers, self.shingles, self.sizes = [], [], [], set()
        for i, (name, text) in enumerate(templates):
            s = windows(h[words.first[i] : words.first[i + 1]], SHINGLE)
            if not len(s):
                raise ValueError(f"a template has fewer than {SHINGLE} words: {text}")
            self.names.append(name)
            self.numbers.append(_numbers(text) if name.rpartition("-")[2].replace(".", "").isdigit() else [])
            self.shingles.append(np.unique(s))
            size = max(x for x in SIZES if x <= len(s))
            self.sizes.add(size)
            begins = {*range(0, len(s) - size + 1, max(1, size // 2)), len(s) - size}
            for at in sorted(begins):
                for key in _band_keys(_minima(s[at : at + size], size, self.n(size), np.zeros(1, np.int64)), size):
                    keys.setdefault(int(key[0]), set()).add(i)
        self.keys = np.array(sorted(keys), np.uint64)
        self.found = [sorted(keys[k]) for k in self.keys.tolist()]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def n(self, size: int) -> int:
        """Signature length: windows of one shingle are equal or not, and need one band."""
        return ROWS * (1 if size == 1 else self.bands)

    def candidates(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, template) for texts (shingle hashes in order) of which a window shares a band with the template."""
        out = set()
        lengths = np.array([len(x) for x in sets], np.int64)
        for size in sorted(self.sizes):
            # after each text so many empty places that no window reaches the next
            room = lengths + size - 1
            begin = np.cumsum(room) - room
            h = np.zeros(int(room.sum()) + size, np.uint64)
            for a, x in zip(begin.tolist(), sets):
                h[a : a + len(x)] = x
            step = max(1, size // 4)
            n = -(-lengths // step)
            text = np.repeat(np.arange(len(sets)), n)
            at = begin[text] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * step
            for key in _band_keys(_minima(h, size, self.n(size), at), size):
                maybe = np.flatnonzero(self.filter[(key >> np.uint64(48)).astype(np.int64)])
                where = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
                ok = self.keys[where] == key[maybe]
                out.update((int(r), t) for r, w in zip(text[maybe[ok]].tolist(), where[ok].tolist()) for t in self.found[w])
        return sorted(out)


def _numbers(text: str) -> list[str]:
    """Runs of digits in order."""
    return re.findall("[0-9]+", text)


def _in_order(few: list[str], many: list[str]) -> bool:
    it = iter(many)
    return all(x in it for x in few)


def contained(s: np.ndarray, template: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """Stretches of s that hold enough of the template: (first shingle, last shingle, distinct shingles held).

    Stretches are up to a quarter longer than the template. Of overlapping ones the fullest is kept, then the shortest, then the first.
    """
    place = np.searchsorted(template, s)
    hit = np.flatnonzero(template[np.minimum(place, len(template) - 1)] == s)
    which = place[hit]
    need, reach = -(-percent * len(template) // 100), len(template) + -(-len(template) // 4)
    found = []
    inside: dict[int, int] = {}
    lo = 0
    for hi in range(len(hit)):
        inside[which[hi]] = inside.get(which[hi], 0) + 1
        while hit[hi] - hit[lo] >= reach or inside[which[lo]] > 1:
            inside[which[lo]] -= 1
            if not inside[which[lo]]:
                del inside[which[lo]]
            lo += 1
        if len(inside) >= need:
            found.append((int(hit[lo]), int(hit[hi]), len(inside)))
    return _apart(found)


def _apart(found):
    """Of overlapping stretches the best."""
    starts: list[int] = []
    stretches: list[tuple[int, int]] = []
    return sorted(x for x in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])) if _apart_from_all(starts, stretches, x[0], x[1]))


def scan(docs: DataFrame, templates=tuple(TEMPLATES), percent: int = PERCENT) -> DataFrame:
    """Licenses in docs (doc_id, text), one row a match: doc_id, license, first_word, last_word, containment.

    Words count from 0 in the folded text. Where matches of several templates overlap, the one with more shingles held
    stays, then the higher containment, then the first template. A notice of another version than the template's is reported
    without version (Apache for Apache-2.0). Null, empty and short texts have no match; rows that repeat a
    doc_id are scanned each for itself; an empty table gives no rows. Whole texts are scanned, a slice of
    a few MB at a time.
    """
    ship(docs.sparkSession)

    @frugal
    def run(batches):
        index = Index(templates)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                w = Words(part, table=_FOLD)
                s = windows(w.hashes(), SHINGLE)
                first = w.first.tolist()
                sets = [s[a : max(a, b - SHINGLE + 1)] for a, b in zip(first[:-1], first[1:])]
                by_row: dict[int, list] = {}
                for row, t in index.candidates(sets):
                    size = len(index.shingles[t])
                    by_row.setdefault(row, []).extend((x, y, n, 100.0 * n / size, t) for x, y, n in contained(sets[row], index.shingles[t], percent))
                out = []
                for row, found in by_row.items():
                    starts: list[int] = []
                    stretches: list[tuple[int, int]] = []
                    kept = [x for x in sorted(found, key=lambda x: (-x[2], -x[3], x[4], x[0])) if _apart_from_all(starts, stretches, x[0], x[1])]
                    text = part[row].as_py().encode() if any(index.numbers[x[4]] for x in kept) else b""
                    base = int(w.bounds[row])
                    for x, y, _, share, t in sorted(kept):
                        name, last = index.names[t], y + SHINGLE - 1
                        if index.numbers[t]:
                            said = text[int(w.starts[first[row] + x]) - base : int(w.ends[first[row] + last]) - base].decode()
                            name = name if _in_order(index.numbers[t], _numbers(said)) else name.rpartition("-")[0]
                        out.append((batch.column(0)[at + row].as_py(), name, x, last, share))
                if out:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "license", "first_word", "last_word", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, first_word long, last_word long, containment double")
