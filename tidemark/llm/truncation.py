"""Texts cut off by field limits: hashed logistic regression on how a value closes.

Positives are made: values are cut at a random place, at a word or inside one, or at a length at which their source
has suspiciously many values end (its field limits), and some get a mark of omission, as senders add. Negatives are
the values as they are, and closed ones without their stop. Those still hold true cuts, so the model is fitted again without the values
the last one takes for cut, neither as negatives nor as material for positives. Values are judged by a model that
was not fitted on them, and open values right at a limit of their source are left out from the start.

Features are hashed: the closing characters and their classes, punctuation, the last words and the words before them
with names and figures masked, the opening words together with the closing ones (headings and captions close without
a stop but open alike), whether words of this shape close values elsewhere, and the distance to the source's limits.

The model is fitted on a bounded sample of values (about SAMPLE rows, chosen by hash, documented and a parameter); the
length histogram behind the limits and the words that tell whole from broken ones come from all values, and every
value is scored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Values the model is fitted on, about.
SAMPLE = 24_000
#: Size of the hashed feature space.
WIDTH = 1 << 18
#: Probability from which a value counts as truncated.
THRESHOLD = 0.5
#: A length is a limit of its source when values stop there this many times as often as in the lengths after it.
PILE = 4.0
#: Log-odds below which a value may serve as intact.
SURE = -1.5
#: Rounds of gradient steps, their size and the weight decay.
EPOCHS, STEP, DECAY = 40, 0.5, 1e-6
RARE = 50
#: A word is whole if it stands so often before the end of a text; so many of them are broadcast, more are joined.
LEAST_WORD, MOST_WORDS = 3, 500_000
MARKS = ("…", "...", " …", " ...")

_OMISSION = re.compile(r"\s*(?:…|\.\.\.+|\[…\]|\[\.\.\.\])\s*$")
_CLOSED = re.compile(r"[.!?。！？।؟]['\"”’»」)\]]*\s*$")
_WORD = re.compile(r"[^\W\d_][\w'’\-]*|\d[\d.,]*|[^\w\s]")
_SENTENCE_END = re.compile(r"[.!?]['\"”’)]?\s")


def mask(word: str) -> str:
    """A word with names and figures masked, so that templates meet."""
    if word[0].isdigit():
        return "9" if "." not in word else "9.9"
    if word[0].isupper():
        return "Xx" if len(word) > 1 else "X"
    return word


def whole_words(rows: DataFrame, least: int = LEAST_WORD) -> DataFrame:
    """word: small-letter words that stand `least` times or more before the end of a `text`, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(_WORD.findall(t)[:-1])
            words = [w for w in seen if w.islower()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

    counts = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).select("word")


def last_word(text: str) -> str:
    """The word a text closes with, without a mark of omission."""
    marked = _OMISSION.search(text)
    words = _WORD.findall((text[: marked.start()] if marked else text)[-48:])
    return words[-1] if words else ""


def features(text: str, limits: dict[int, float], words_known: frozenset[str] = frozenset()) -> list[int]:
    """Hashed features of a non-empty text; `limits` are those of its source, `words_known` tells whole words."""
    marked = _OMISSION.search(text)
    body = text[: marked.start()] if marked else text
    mark = "m" + repr(marked.group()) if marked else "-"
    closed = bool(_CLOSED.search(body))
    tail = body[-48:]
    words = _WORD.findall(tail)
    last = words[-1] if words else ""
    shapes = [mask(w) for w in words[-4:]] or [""]
    head = [mask(w) for w in _WORD.findall(body[:40])[:4]]
    inner = bool(_SENTENCE_END.search(body))
    kind = "c" if closed else "o"
    space = "s" if body[-1:].isspace() else ""
    whole = "C" if last[:1].isupper() else "k" if last in words_known else "n" if last.isalpha() else "p"
    spaces = min(body.count(" "), 24)
    near = min((n - len(text) for n in limits if n >= len(text)), default=99)
    at = f"L{min(near, 9)}" if near < 10 else "L-"
    open_quote = (body.count("“") > body.count("”")) or body.count('"') % 2 == 1
    open_bracket = body.count("(") > body.count(")")
    base = f"{mark}{kind}{space}"
    names = [
        "bias",
        f"b:{base}",
        f"bi:{base}{inner}",
        f"q:{kind}{open_quote}{open_bracket}",
        f"c1:{base}{body[-1:]}",
        f"c2:{base}{body[-2:]}",
        f"c3:{kind}{body[-3:]}",
        f"w1:{base}{shapes[-1]}",
        f"w2:{base}{' '.join(shapes[-2:])}",
        f"w3:{base}{' '.join(shapes[-3:])}",
        f"w4:{kind}{' '.join(shapes)}",
        f"l1:{base}{last.lower()}",
        f"h1:{base}{inner}{' '.join(head[:1])}",
        f"h2:{base}{inner}{' '.join(head[:2])}",
        f"h3:{base}{inner}{' '.join(head[:3])}",
        f"h4:{base}{inner}{' '.join(head)}",
        f"hw:{base}{' '.join(head[:2])}|{' '.join(shapes[-2:])}",
        f"h1w:{base}{' '.join(head[:1])}|{shapes[-1]}",
        f"h3w:{base}{' '.join(head[:3])}|{shapes[-1]}",
        f"n:{base}{inner}{min(len(words), 9)}",
        f"wl:{kind}{min(len(last), 8)}{last[:1].isupper()}",
        f"v:{base}{whole}",
        f"vh:{base}{whole}{spaces}|{' '.join(head[:3])}",
        f"vh1:{base}{whole}{spaces}|{' '.join(head[:1])}",
        f"vh2:{base}{whole}{spaces}|{' '.join(head[:2])}",
        # length and limits last: the first round of `fit` does without them
        f"lim:{base}{at}",
        f"len:{base}{inner}{min(len(text) // 12, 30)}",
    ]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (WIDTH - 1) for n in names]


N_FEATURES = len(features("x", {}))
#: How many of them are about length and limits.
N_LENGTH = 2


def truncate(text: str, limits: list[int], rng: np.random.Generator) -> str | None:
    """`text` cut as a field limit or a broken transfer would; None where nothing can be cut."""
    if len(text) < 12:
        return None
    fits = [n for n in limits if 8 <= n < len(text) - 2]
    if fits and rng.random() < 0.5:
        at = int(fits[rng.integers(len(fits))])
    else:
        at = int(rng.integers(6, len(text) - 2))
    short = text[:at]
    way = rng.random()
    if way < 0.4 and " " in short.strip():  # cut back to a word
        short = short[: short.rstrip().rfind(" ") + (rng.random() < 0.15)]
    if rng.random() < 0.45:
        short = short.rstrip() + MARKS[rng.integers(len(MARKS))] if rng.random() < 0.7 else short + MARKS[rng.integers(len(MARKS))]
    return short if short.strip() and short.rstrip() != text.rstrip() and not (_CLOSED.search(short) and not short[-1].isspace() and not _OMISSION.search(short)) else None


def descend(rows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, step: float = STEP, decay: float = DECAY) -> np.ndarray:
    """Weights of a logistic regression on hashed features (adaptive full-batch gradient descent).

    The floor under the step sizes keeps features with little support (below some RARE rows) near 0, so that no row is
    learned by heart: the negatives hold true cuts.
    """
    floor = (0.5 * RARE / len(y)) ** 2
    w = np.zeros(WIDTH)
    seen = np.zeros(WIDTH)
    flat = rows.ravel()
    for _ in range(epochs):
        p = 1.0 / (1.0 + np.exp(-w[rows].sum(axis=1)))
        g = np.bincount(flat, weights=np.repeat(p - y, rows.shape[1]), minlength=WIDTH) / len(y) + decay * w
        seen += g * g
        w -= step * g / np.sqrt(seen + floor)
    return w


def fit(values: list[tuple[str, str]], limits: dict[str, dict[int, float]], words_known: frozenset[str], seed: int = 7) -> np.ndarray:
    """Weights from (source, text) values; see the module's text.

    Values are judged by a model that has not seen them (two halves, each judged by the other's model). The first
    round leaves out length and limits: true cuts among its negatives lie close together there, and would teach the
    model that a field limit is a sign of an intact value.
    """
    rng = np.random.default_rng(seed)
    whole = np.array([features(t, limits.get(s, {}), words_known) for s, t in values], dtype=np.int32).reshape(-1, N_FEATURES)
    known = sorted({n for by in limits.values() for n in by})
    made, of = [], []
    for i, (s, t) in enumerate(values):
        own = list(limits.get(s, {})) or known
        for _ in range(3):  # far more positives than true cuts among the negatives
            if (short := truncate(t, own, rng)) is not None:
                made.append(features(short, limits.get(s, {}), words_known))
                of.append(i)
    # a finished text may lack its closing stop: values without theirs are intact, too
    bare = [(i, s, t.rstrip()[:-1]) for i, (s, t) in enumerate(values) if t.rstrip().endswith(".") and not _OMISSION.search(t) and len(t.rstrip()) > 12]
    stopless = np.array([features(t, limits.get(s, {}), words_known) for _, s, t in bare], dtype=np.int32).reshape(-1, N_FEATURES)
    bare_of = np.array([i for i, _, _ in bare], dtype=np.int64)
    cut, source = np.array(made, dtype=np.int32).reshape(-1, N_FEATURES), np.array(of, dtype=np.int64)
    # open values right at a limit of their source are suspects from the start
    keep = np.array([not (len(t) in limits.get(s, {}) and (not _CLOSED.search(t) or bool(_OMISSION.search(t)))) for s, t in values], dtype=bool)
    half = np.arange(len(values)) % 2

    def train(mine: np.ndarray, columns: int) -> np.ndarray:
        positive = cut[mine[source]]
        if not len(positive) or not mine.any():
            return np.zeros(WIDTH)
        negative = np.concatenate([whole[mine], stopless[mine[bare_of]]])
        rows = np.concatenate([negative, positive])[:, :columns]
        return descend(rows, np.concatenate([np.zeros(len(negative)), np.ones(len(positive))]))

    for columns in (N_FEATURES - N_LENGTH, N_FEATURES, N_FEATURES):
        judged = np.zeros(len(values))
        for f in (0, 1):
            judged[half != f] = train(keep & (half == f), columns)[whole[half != f][:, :columns]].sum(axis=1)
        keep = judged < SURE
    return train(keep, N_FEATURES)


def source_limits(lengths: list[tuple[str, int, int]], least: int = 8) -> dict[str, dict[int, float]]:
    """source -> limit -> share of values at it, from (source, length, values).

    A limit is a length at which values pile up against the 12 lengths from 3 above it on.
    """
    by: dict[str, dict[int, int]] = {}
    for source, n, count in lengths:
        by.setdefault(source, {})[n] = count
    out: dict[str, dict[int, float]] = {}
    for source, hist in by.items():
        total = sum(hist.values())
        for n, count in hist.items():
            after = sum(hist.get(n + i, 0) for i in range(3, 15)) / 12
            if count >= least and count >= 0.02 * total and count > PILE * max(after, 1.0):
                out.setdefault(source, {})[n] = count / total
    return out


@dataclass(frozen=True)
class Model:
    """Weights, limits by source, and the words that tell whole from broken ones; `words`: the table of them where they are too many to broadcast."""

    weights: np.ndarray
    limits: dict[str, dict[int, float]]
    words_known: frozenset[str]
    words: DataFrame | None = None


def fit_model(values: DataFrame, sample: int = SAMPLE, seed: int = 7, most_words: int = MOST_WORDS) -> Model:
    """The model of `values` (source, text, row_id): limits and whole words from all of them, weights from about `sample`.

    The histogram of lengths by source (sources are few), `most_words` words and the sample are all that comes to the driver. Rows are in
    the sample or not by the hash of their id and text, whatever the partitioning. Null and blank texts are left out.
    """
    rows = values.where(F.col("text").rlike(r"\S")).select(F.coalesce("source", F.lit("")).alias("source"), "text", "row_id")
    open_end = ~F.col("text").rlike(r"[.!?][\"”’)]?\s*$") | F.col("text").rlike(r"(…|\.\.\.)\s*$")
    inner = F.col("text").rlike(r"[.!?][\"”’)]?\s\S")  # headings and captions have lengths of their own, but no limit
    sized = rows.groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("all"), F.count_if(open_end & inner).alias("open"))
    lengths = sized.collect()  # sources times distinct lengths
    limits = source_limits([(r["source"], r["n"], r["open"]) for r in lengths if r["open"]])
    share = min(1.0, sample / max(1, sum(r["all"] for r in lengths)))
    chance = F.pmod(F.xxhash64("row_id", "text", F.lit(seed)), F.lit(1_000_000))
    picked = sorted((r["source"], r["text"]) for r in rows.where(chance < int(share * 1_000_000)).select("source", "text").collect())
    random.Random(seed).shuffle(picked)
    words = cut(whole_words(rows))
    known = words.limit(most_words + 1).collect()
    if len(known) <= most_words:
        words_known = frozenset(r["word"] for r in known)
        return Model(fit(picked, limits, words_known, seed).astype(np.float32), limits, words_known)
    # the fit asks for words of the sample, whole or cut, and no others
    parts = sorted({w[:n] for _, t in picked for w in _WORD.findall(t) for n in range(1, len(w) + 1) if w.islower()})
    asked = values.sparkSession.createDataFrame([(w,) for w in parts], "word string")
    words_known = frozenset(r["word"] for r in words.join(asked, "word", "left_semi").collect())
    return Model(fit(picked, limits, words_known, seed).astype(np.float32), limits, frozenset(), words)


ROWS = "text string, source string, parent string, parent_cut boolean, tbl string, row_id long"
SCORED = "tbl string, source string, row_id long, text string, p double, cut boolean"


def _with_last_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("word", pa.array([last_word(t) for t in batch.column(0).to_pylist()], pa.string()))


def truncated(values: DataFrame, model: Model) -> DataFrame:
    """tbl, source, row_id, text, p (the probability that the text was cut), cut of `values` (tbl, source, row_id, text,
    parent, parent_cut).

    `cut`: p is at least THRESHOLD. Where `parent` (the stored record of a delivered text, or null) is the same text,
    its verdict `parent_cut` counts instead; where it goes on after the text stops, the text is cut. Null and blank
    texts are left out; rows are scored one by one, repeated ones alike.
    """
    rows = values.where(F.col("text").rlike(r"\S"))
    if "parent_cut" not in values.columns:
        rows = rows.withColumn("parent_cut", F.lit(None).cast("boolean"))
    shared = values.sparkSession.sparkContext.broadcast(replace(model, words=None))
    names = ["text", "source", "parent", "parent_cut", "tbl", "row_id"]
    rows = rows.select(*names)
    if model.words is not None:
        ended = rows.mapInArrow(_with_last_word, f"{ROWS}, word string")
        rows = ended.join(model.words.withColumn("whole", F.lit(True)), "word", "left").select(*names, F.when(F.col("whole"), F.col("word")).alias("whole"))
    else:
        rows = rows.withColumn("whole", F.lit(None).cast("string"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts, sources, parents, verdicts, wholes = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6))
            if not texts:
                continue
            idx = np.array([features(t, known.limits.get(s or "", {}), frozenset((w,)) if w else known.words_known) for s, t, w in zip(sources, texts, wholes, strict=True)], dtype=np.int32)
            p = 1.0 / (1.0 + np.exp(-known.weights[idx].sum(axis=1, dtype=np.float64)))
            cut_ = p >= THRESHOLD
            for i, (t, o, v) in enumerate(zip(texts, parents, verdicts, strict=True)):
                if o is not None and (t := t.rstrip()) == (o := o.rstrip()):
                    cut_[i] = cut_[i] if v is None else v
                elif o and o.startswith(t):
                    cut_[i] = True
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(1), batch.column(5), batch.column(0), pa.array(p), pa.array(cut_)], names=["tbl", "source", "row_id", "text", "p", "cut"])

    return rows.mapInArrow(score, SCORED)


def truncated_copies(stored: DataFrame, copies: DataFrame, model: Model) -> DataFrame:
    """`truncated` of stored rows (tbl, source, row_id, text) and of delivered copies (with `parent_id`, the row_id of
    the stored record). Stored rows are scored first, and their verdict goes along with their copies."""
    first = cut(truncated(stored.withColumn("parent", F.lit(None).cast("string")), model))
    # a record delivered again is one parent
    parents = first.groupBy(F.col("row_id").alias("parent_id"), F.col("text").alias("parent")).agg(F.max("cut").alias("parent_cut"))
    return first.unionByName(truncated(copies.join(parents, "parent_id", "left").drop("parent_id"), model))
