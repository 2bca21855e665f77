"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming blocks, exact verification.

Both sides are reduced to their letters and digits in lower case. An evaluation item is a set of windows of SIZE
characters at every position; a document is a set of windows at every STRIDE-th position, so any shared run of
SIZE + STRIDE - 1 characters or more holds a document window whole. Each window gets a 64-bit SimHash of its
character GRAM-grams.

The fingerprints of a group of items (of bounded size, broadcast) are indexed by RADIUS + 1 blocks of bits: two
fingerprints within RADIUS differ nowhere in at least one block, so looking up every block finds all of them. Equal
fingerprints of a text are looked up once. Candidates are verified on the texts: the weighted similarity of the gram
multisets of the two windows, and then, of document and item, the longest common run and the weighted similarity of
the whole item with the item-sized window of the document that the matched windows lie in.

Item-sized windows are verified, not fingerprinted: an item-sized window of similarity 0.8 or more has at most a ninth
of its grams broken, which leaves an unbroken run of about 44 characters for long items, and more than 38 for all but
evenly spaced changes of short ones; that run holds a small window whole. So the small windows find the item-sized
ones, and passages that are only a part of an item besides.

Items beyond GROUP_CHARS are dealt into groups that are broadcast one after the other; the driver holds one group at a
time, and no item is left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread

#: Window and stride of documents; every shared run of SIZE + STRIDE - 1 = 38 characters holds a whole window.
SIZE, STRIDE, GRAM = 32, 7, 5
#: Fingerprints within this Hamming distance are all found.
RADIUS = 3
#: Characters of items broadcast at once (16 bytes of index a character).
GROUP_CHARS = 2_000_000
#: Shortest exact run that counts as leaked.
RUN = 40
#: Weighted similarity from which an altered window counts as leaked in `leaks`.
SIMILAR = 0.8

#: Texts are fingerprinted so many characters at a time, with overlap: memory is bounded for texts of any length.
CHUNK = 7 * 8192
#: Characters of texts that are looked up together, about.
TOGETHER = 100_000
#: Candidate pairs looked at together.
PAIRS = 1_000_000
_GRAMS = SIZE - GRAM + 1  # 28 = 4 strides
LEAKS = "doc_key long, item_key long, windows int, similarity double, run int, whole double"
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """The letters and digits of `text` in lower case."""
    return _OTHER.sub("", text.lower())


def _gram_hashes(text: str) -> np.ndarray:
    """A mixed 64-bit hash of every GRAM-gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(GRAM):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(text: str, stride: int) -> np.ndarray:
    """SimHash of the windows at 0, stride, ... (1 or STRIDE); `text` is normal. Fewer than SIZE characters have none."""
    parts = [_window_prints(text[i : i + CHUNK + SIZE - 1], stride) for i in range(0, max(len(text) - SIZE + 1, 1), CHUNK)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _window_prints(text: str, stride: int) -> np.ndarray:
    h = _gram_hashes(text)
    if len(h) < _GRAMS:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    if stride == STRIDE:  # 28 grams a window are 4 blocks of 7
        n = len(h) // STRIDE
        blocks = bits[: n * STRIDE].reshape(n, STRIDE, 64).sum(axis=1, dtype=np.uint8)
        sums = blocks[:-3] + blocks[1:-2] + blocks[2:-1] + blocks[3:]
    else:
        total = np.vstack([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        sums = total[_GRAMS:] - total[:-_GRAMS]
    return np.packbits(sums > _GRAMS // 2, axis=1).view(np.uint64).ravel()


class Index:
    """The windows of a group of items: each fingerprint of an item once, by the blocks of its bits."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS) -> None:
        self.keys = [k for k, _ in items]
        self.texts = [t for _, t in items]
        prints = [fingerprints(t, 1) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(p) for p in prints]).astype(np.int32)
        at = np.concatenate([np.arange(len(p)) for p in prints] or [np.zeros(0)]).astype(np.int32)
        every = np.concatenate(prints or [np.zeros(0, np.uint64)]).astype(np.uint64)
        order = np.lexsort((at, every, item))
        item, every, self.at = item[order], every[order], at[order]
        first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (every[1:] != every[:-1])]) if len(item) else np.zeros(0, np.int64)
        self.edges = np.r_[first, len(item)]
        self.item, self.prints = item[first], every[first]
        self.radius = radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            cells = self._block(self.prints, low, high)
            order = np.argsort(cells, kind="stable").astype(np.int32)
            starts = np.zeros((1 << (high - low)) + 1, dtype=np.int32)
            np.add.at(starts, cells.astype(np.int64) + 1, 1)
            self.blocks.append((low, high, order, np.cumsum(starts, dtype=np.int32)))

    def places(self, window: int) -> list[int]:
        """Where in its item the windows with the fingerprint number `window` begin."""
        return self.at[self.edges[window] : self.edges[window + 1]].tolist()

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, window) of every pair of fingerprints within the radius; found in several blocks, given once."""
        found = []
        for low, high, order, starts in self.blocks:
            cells = self._block(prints, low, high).astype(np.int64)
            first, n = starts[cells], starts[cells + 1] - starts[cells]
            hit = np.flatnonzero(n)
            sums = np.cumsum(n[hit], dtype=np.int64)
            # at most about PAIRS candidates are looked at together
            for part in np.split(hit, np.searchsorted(sums, np.arange(PAIRS, int(sums[-1]), PAIRS)) if len(hit) else []):
                m = n[part]
                q = np.repeat(part, m)
                w = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[part], m)]
                close = np.bitwise_count(prints[q] ^ self.prints[w]) <= self.radius
                found.append(q[close].astype(np.int64) * len(self.prints) + w[close])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


def weighted_similarity(a: str, b: str) -> float:
    """Sum of minima over sum of maxima of the gram counts of two normal texts."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for side, text in enumerate((a, b)):
        for i in range(len(text) - GRAM + 1):
            counts[text[i : i + GRAM]][side] += 1
    most = sum(max(c) for c in counts.values())
    return sum(min(c) for c in counts.values()) / most if most else 0.0


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the mixed characters times the powers of a base, and the powers of its inverse."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(31)
    power = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    return np.r_[np.uint64(0), np.cumsum(codes * power)], np.r_[np.uint64(1), np.cumprod(np.full(len(codes), _BACK, np.uint64))]


def longest_run(a: str, b: str) -> int:
    """Length of the longest common run of two texts: a binary search over hashes of all runs of one length.

    Runs that agree by their hash are compared as text, so a chance agreement can't lengthen the result.
    """
    (sa, pa_), (sb, pb) = _sums(a), _sums(b)

    def shared(n: int) -> bool:
        x, y = (sa[n:] - sa[:-n]) * pa_[: len(sa) - n], (sb[n:] - sb[:-n]) * pb[: len(sb) - n]
        common, i, j = np.intersect1d(x, y, return_indices=True)
        return any(a[p : p + n] == b[q : q + n] for p, q in zip(i.tolist(), j.tolist(), strict=True))

    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if shared(middle) else (low, middle)
    return low


def _groups(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in normal form, in groups of about `limit` characters, dealt by hash; one group is on the driver at a time."""
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(f"k is not null and length(t) >= {SIZE}").distinct()
    rows = cut(rows)
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-total // limit)
    for g in range(n):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == g).collect()
        group = sorted((r["k"], t) for r in part if len(t := normal(r["t"])) >= SIZE)
        if group:
            yield group


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, radius: int = RADIUS, similar: float = SIMILAR, group_chars: int = GROUP_CHARS) -> DataFrame:
    """doc_key, item_key, windows (matched), similarity (best window), run (longest exact run, in letters and digits),
    whole (best similarity of the whole item with an item-sized window).

    A row for each document and item with a window pair within `radius` whose weighted similarity is at least
    `similar`. Null texts and texts of fewer than SIZE letters and digits match nothing; repeated documents are
    compared row by row and give one row each document and item; keys must be BIGINT.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t")).where(f"k is not null and length(t) >= {SIZE}"))
    found = None
    for group in _groups(items, item_key, item_text, group_chars):
        shared = spark.sparkContext.broadcast(group)
        part = rows.mapInArrow(_searcher(shared, radius, similar), LEAKS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], LEAKS)
    best = found.groupBy("doc_key", "item_key").agg(*[F.max(c).alias(c) for c in ("windows", "similarity", "run", "whole")])
    return best.toDF(doc_key, item_key, "windows", "similarity", "run", "whole")


def matches(texts: list[str], index: Index, similar: float = SIMILAR) -> Iterator[tuple[int, int, int, float, int, float]]:
    """(number in `texts`, item number, windows, similarity, run, whole) of each item that a normal text holds similar
    windows of. The texts are fingerprinted and looked up together, laid out so that windows start where they would
    alone; windows over two texts are left out."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    room = -(-sizes // STRIDE) * STRIDE
    starts = np.cumsum(room) - room
    prints = fingerprints("".join(t + " " * int(r - n) for t, n, r in zip(texts, sizes.tolist(), room.tolist(), strict=True)), STRIDE)
    at = np.arange(len(prints)) * STRIDE
    owner = np.searchsorted(starts, at, side="right") - 1
    held = np.flatnonzero(at + SIZE <= starts[owner] + sizes[owner]) if len(at) else np.zeros(0, np.int64)
    unique, first = np.unique(prints[held], return_inverse=True)
    q, w = index.near(unique)
    if not len(q):
        return
    order = held[np.argsort(first, kind="stable")]
    ends = np.cumsum(np.bincount(first, minlength=len(unique)))
    # each text and item with the fingerprints they meet in: the text's windows are order[low:high]
    met: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for u, window in zip(q.tolist(), w.tolist(), strict=True):
        low, high = int(ends[u - 1]) if u else 0, int(ends[u])
        mine = owner[order[low:high]]
        edges = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), high - low]
        for i, j in zip(edges, edges[1:], strict=False):
            met[int(mine[i]), int(index.item[window])].append((window, low + i, low + j))
    for (number, item), pairs in met.items():
        text, theirs_text = texts[number], index.texts[item]
        best, spots, places = 0.0, set(), set()
        for window, low, high in pairs:
            own = [int(p) * STRIDE - int(starts[number]) for p in order[low:high]]
            mine = {text[p : p + SIZE]: p for p in reversed(own)}
            theirs = {theirs_text[p : p + SIZE]: p for p in reversed(index.places(window))}
            if same := mine.keys() & theirs.keys():
                similarity = 1.0
                places.update(mine[t] - theirs[t] for t in same)
            else:
                similarity, place = max((weighted_similarity(a, b), mine[a] - theirs[b]) for a in mine for b in theirs)
                if similarity < similar:
                    continue
                places.add(place)
            spots.update(own)
            best = max(best, similarity)
        if spots:
            size = len(theirs_text)
            whole = max(weighted_similarity(text[max(0, p) : p + size], theirs_text) for p in places)
            yield number, item, len(spots), best, longest_run(text, theirs_text), whole


def _searcher(shared, radius: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, radius)
        for batch in batches:
            out: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(1).to_pylist()]
            sums = np.cumsum([len(t) for t in texts])
            edges = [0, *np.searchsorted(sums, np.arange(TOGETHER, int(sums[-1]) if len(sums) else 0, TOGETHER)).tolist(), len(texts)]
            for low, high in zip(edges, edges[1:], strict=False):
                if high > low:
                    out += [(keys[low + i], index.keys[item], *found) for i, item, *found in matches(texts[low:high], index, similar)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_key", "item_key", "windows", "similarity", "run", "whole"])

    return run
