"""Toxicity by class-conditional Kneser-Ney models over byte n-grams, compared as length-normalised log-likelihoods.

An n-gram is a byte and what its word has before it, back to the blank before the word or to five bytes. The
log-likelihoods of both classes are compared over the whole text, by its length, and over its worst stretch of
STRETCH bytes, so that an expression in a long text isn't thinned out by the rest.
The highest order is counted for toxic and for ordinary texts apart; all lower orders are continuation counts of
both together. An expression that neither class has seen falls back on the same shared distribution in both, so it
speaks for neither beyond what its context says. Counts, continuation counts and the model are Spark tables that
grow with the labelled texts; a block of documents asks for the n-grams that it holds and no others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import block_count, block_of, dealt, id_and_text, pack_arrays, planes, unpack_arrays, unpacked, unplaned, written

ORDER = 6
#: Bytes of the stretch of a text that is compared on its own.
STRETCH = 12
#: Observations of a context that the shared distribution counts for in either class, beside the discounted mass.
PRIOR = 5.0
#: Labelled documents held back from the counts, with which the score is calibrated: every fourth, by a hash of the id.
CALIBRATION_SHARE = 4
#: So many ids are held back at most, those with the least hashes; all others are counted.
CALIBRATION_ROWS = 50_000
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
LOWER = bytes(0x20 if c in range(9, 14) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def byte_grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text but its first: the byte and those before it in its word, and the text of each.

    A-Z is lower-cased, a run of white space is one blank, and each text stands between two blanks. A key holds
    ``order`` bytes at most, of which the blank before the word is the first there can be; zeros fill it up. The blank
    behind a word has the word's end before it. Texts without words have no key.
    """
    data = np.frombuffer(b"".join(b" " + t.translate(LOWER) + b" " for t in texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (owner[1:] != owner[:-1])
    data, owner = data[keep], owner[keep]
    blank = data == 0x20
    within = np.arange(len(data)) - np.maximum.accumulate(np.where(blank, np.arange(len(data)), 0))
    within[1:][blank[1:]] = within[:-1][blank[1:]] + 1  # bytes since the blank before the word
    keys = data.astype(np.uint64)
    for i in range(1, order):
        keys[i:] |= np.where(within[i:] >= i, data[:-i].astype(np.uint64), np.uint64(0)) << np.uint64(8 * i)
    inside = np.append(False, owner[1:] == owner[:-1])
    return keys[inside], owner[inside].astype(np.int64)


def peaks(worth: np.ndarray, owner: np.ndarray, texts: int, stretch: int) -> np.ndarray:
    """The largest sum of ``stretch`` consecutive values of each text (of as many as there are, at its beginning); 0 for none."""
    upto = np.append(0.0, np.cumsum(worth))
    at = np.arange(len(worth))
    first = np.maximum(at - stretch + 1, np.searchsorted(owner, owner))
    out = np.full(texts, -np.inf)
    np.maximum.at(out, owner, upto[at + 1] - upto[first])
    return np.where(np.isfinite(out), out, 0.0)


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def class_counts(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, toxic, ordinary``: how often each n-gram stands in the texts of either class.

    A repeated expression counts each time, in the counts as in ``log_ratios``. ``labels`` has ``doc_id, label`` (0 or
    1) of some of ``docs``, at most once for an id. Texts and labels are dealt
    by the same hash, so that no text is joined row by row.
    """
    docs = id_and_text(docs)
    blocks = block_count(docs, BLOCK_BYTES)

    def count(key: tuple, group: pa.Table, known: pa.Table) -> pa.Table:
        label = dict(zip(known.column("doc_id").to_pylist(), known.column("label").to_pylist(), strict=True)) if known.num_rows else {}
        grams, classes = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for own, texts in unpacked(group.column("payload")) if label and group.num_rows else []:
            chosen = [i for i, d in enumerate(own) if d in label]
            labels = np.array([label[own[i]] for i in chosen], np.int64)
            for first, part in _batches([texts[i] for i in chosen]):
                keys, owner = byte_grams(part, order)
                value, place = np.unique(keys, return_inverse=True)
                grams.append(value)
                toxic = labels[first + owner]
                classes.append(np.stack([np.bincount(place, toxic, len(value)), np.bincount(place, 1 - toxic, len(value))], axis=1).astype(np.int64))
        value, n = summed(np.concatenate(grams), np.concatenate(classes))
        part = _part(value >> np.uint64(8), parts)
        turn = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[turn], np.arange(parts + 1)).tolist()
        out = [(p, turn[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        packed = [pack_arrays(np.diff(value[at], prepend=np.uint64(0)), *(n[at, k].astype(np.uint32) for k in (0, 1))) for _, at in out]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "payload": pa.array(packed, pa.binary())})

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        got = [unpack_arrays(x) for x in group.column("payload").to_pylist()]
        value, n = summed(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), np.concatenate([np.stack(g[1:], axis=1).astype(np.int64) for g in got]))
        return pa.table({"gram": value.view(np.int64), "toxic": n[:, 0], "ordinary": n[:, 1]})

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, place = np.unique(keys, return_inverse=True)
        return value, np.stack([np.bincount(place, n[:, k], len(value)) for k in (0, 1)], axis=1).astype(np.int64)

    parts = _parts(docs, blocks)
    known = labels.withColumn("block", block_of(blocks))
    counts = dealt(docs, blocks).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(count, "part int, payload binary")
    return counts.groupBy("part").applyInArrow(merge, "gram long, toxic long, ordinary long")


def _discount(once: int | None, twice: int | None) -> float:
    once, twice = once or 0, twice or 0
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, llr``: log P(byte | context, toxic) - log P(byte | context, ordinary) for n-grams of ``class_counts``.

    Rows with ``whole`` false give it for any byte not seen behind a context (``gram`` is then the context). Of a
    context that neither class has seen it is nought. ``counts`` is read several times and should be a written table.
    """
    low = lambda c, m: F.col(c).bitwiseAND(F.lit((1 << (8 * m)) - 1))
    # the shared distribution, from single bytes up to order - 1: a gram counts once for each distinct longer one that ends with it
    shared, levels = None, {order: counts.select("gram")}
    for m in range(order - 1, 0, -1):
        levels[m] = written(levels[m + 1].groupBy(low("gram", m).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{m}")
    for m in range(1, order):
        level = levels[m]
        d = _discount(*level.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())
        context = F.shiftright("gram", 8)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        rows = level.withColumn("context", context).join(totals, "context")
        own, rest = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total"), d * F.col("types") / F.col("total")
        if m == 1:
            shared = rows.select("gram", (own + rest / 256).alias("shared"))
        else:
            below = shared.select(F.col("gram").alias("_tail"), F.col("shared").alias("_below"))
            shared = rows.withColumn("_tail", low("gram", m - 1)).join(below, "_tail").select("gram", (own + rest * F.col("_below")).alias("shared"))
        shared = written(shared, f"shared{m}")
    once = counts.agg(*[F.count_if(F.col(c) == k) for c in ("toxic", "ordinary") for k in (1, 2)]).first()
    d = {"toxic": _discount(once[0], once[1]), "ordinary": _discount(once[2], once[3])}
    context = F.shiftright("gram", 8)
    sums = [f(c).alias(f"{c}_{x}") for c in d for x, f in (("total", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))]
    totals = written(counts.groupBy(context.alias("context")).agg(*sums), "contexts")
    left = {c: (d[c] * F.col(f"{c}_types") + PRIOR) / (F.col(f"{c}_total") + PRIOR) for c in d}
    own = {c: F.greatest(F.col(c) - d[c], F.lit(0.0)) / (F.col(f"{c}_total") + PRIOR) for c in d}
    below = shared.select(F.col("gram").alias("_tail"), "shared")
    rows = counts.withColumn("context", context).withColumn("_tail", low("gram", order - 1)).join(totals, "context").join(below, "_tail")
    ratio: Column = F.log(own["toxic"] + left["toxic"] * F.col("shared")) - F.log(own["ordinary"] + left["ordinary"] * F.col("shared"))
    seen = rows.select("gram", F.lit(True).alias("whole"), ratio.cast("float").alias("llr"))
    return seen.unionByName(totals.select(F.col("context").alias("gram"), F.lit(False).alias("whole"), (F.log(left["toxic"]) - F.log(left["ordinary"])).cast("float").alias("llr")))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    return zstandard.compress(planes(np.diff(keys, prepend=np.uint64(0))), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(zstandard.decompress(data), np.uint64), dtype=np.uint64)


def log_ratios(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_grams, llr`` (the sum over the text) ``, peak`` (over its worst stretch) for each row of ``docs``; null texts are empty and have nought of each.

    Each n-gram's log-ratio travels in 16 bits, so to three digits; one that rounds to nought counts as nought.
    """
    docs = id_and_text(docs)
    blocks = block_count(docs, BLOCK_BYTES)
    parts = _parts(docs, blocks)
    rows = dealt(docs, blocks)
    message = "block int, part int, payload binary"

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        found = [np.unique(byte_grams(part, order)[0]) for _, texts in unpacked(group.column("payload")) for _, part in _batches(texts)]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        part = _part(keys >> np.uint64(8), parts)
        order_ = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order_], np.arange(parts + 1)).tolist()
        out = [(p, _packed(keys[order_[a:b]])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return _messages([key[0].as_py()] * len(out), [p for p, _ in out], [x for _, x in out])

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        whole = known.column("whole").to_numpy(zero_copy_only=False) if known.num_rows else np.zeros(0, bool)
        gram = known.column("gram").to_numpy().view(np.uint64) if known.num_rows else np.zeros(0, np.uint64)
        llr = known.column("llr").to_numpy() if known.num_rows else np.zeros(0, np.float32)
        tables = []
        for chosen in (whole, ~whole):
            at = np.argsort(gram[chosen])
            tables.append((gram[chosen][at], llr[chosen][at]))
        out = []
        for payload in asked.column("payload").to_pylist() if asked.num_rows else []:
            keys = _unpacked(payload)
            values, open_ = np.zeros(len(keys), np.float32), np.ones(len(keys), bool)
            for (have, worth), want in zip(tables, (keys, keys >> np.uint64(8)), strict=True):
                if len(have):
                    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                    hit = open_ & (have[at] == want)
                    values[hit] = worth[at[hit]]
                    open_ &= ~hit
            values = values.astype(np.float16)
            some = values != 0  # what is not in the answer is worth nought
            out.append(pickle.dumps((_packed(keys[some]), zstandard.compress(planes(values[some]), 1)), 5))
        return _messages(asked.column("block").to_pylist() if out else [], asked.column("part").to_pylist() if out else [], out)

    def total(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        got = [pickle.loads(x) for x in answers.column("payload").to_pylist()] if answers.num_rows else []
        keys = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(k) for k, _ in got)])
        values = np.concatenate([np.zeros(0, np.float32), *(unplaned(zstandard.decompress(v), np.float16).astype(np.float32) for _, v in got)])
        worth = Lookup(keys, values)
        ids, n_grams, llr, peak = [], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for own, texts in unpacked(group.column("payload")) if group.num_rows else []:
            ids += own
            for _, part in _batches(texts):
                keys, owner = byte_grams(part, order)
                n_grams.append(np.bincount(owner, minlength=len(part)))
                values = worth(keys).astype(float)
                llr.append(np.bincount(owner, values, minlength=len(part)))
                peak.append(peaks(values, owner, len(part), STRETCH))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_grams": np.concatenate(n_grams).astype(np.int64), "llr": np.concatenate(llr), "peak": np.concatenate(peak)})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, whole = b.column("gram").to_numpy().view(np.uint64), b.column("whole").to_numpy(zero_copy_only=False)
            part = _part(np.where(whole, gram >> np.uint64(8), gram), parts).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"gram": b.column("gram"), "whole": b.column("whole"), "llr": b.column("llr"), "part": part})

    known = model.mapInArrow(placed, "gram long, whole boolean, llr float, part int")
    answers = rows.groupBy("block").applyInArrow(ask, message).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, message)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, n_grams long, llr double, peak double")


class Lookup:
    """Values of keys through a table of their hashes; keys that aren't there are worth nought."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, np.float32(0))
        at = self._slot(keys)
        self.table = np.full(1 << self.bits, len(keys), np.int32)
        self.table[at] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.table[at] != np.arange(len(keys)))  # another key has taken their slot
        lost = lost[np.argsort(keys[lost])]
        self.more = (keys[lost], values[lost])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        out = np.where(self.keys[at] == keys, self.values[at], np.float32(0))
        if len(self.more[0]) and len(keys):
            open_ = np.flatnonzero(self.keys[at] != keys)
            at = np.minimum(np.searchsorted(self.more[0], keys[open_]), len(self.more[0]) - 1)
            hit = self.more[0][at] == keys[open_]
            out[open_[hit]] = self.more[1][at[hit]]
        return out


def _parts(docs: DataFrame, blocks: int) -> int:
    """As many parts as blocks, but no fewer than shuffle partitions: a short table spreads too."""
    return max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _part(context: np.ndarray, parts: int) -> np.ndarray:
    return ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)


def _messages(block: list, part: list, payload: list) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int32()), "payload": pa.array(payload, pa.binary())})


def in_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass(frozen=True)
class Calibration:
    """Weights of the worst stretch's log-ratio, of the text's mean one, of its sum over the root of the length, of the length's logarithm, and a constant."""

    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -1.0)

    def score(self) -> Column:
        n = F.greatest("n_grams", F.lit(1)).cast("double")
        a, b, c, d, e = self.weights
        z = F.lit(a) * F.col("peak") + F.lit(b) * F.col("llr") / n + F.lit(c) * F.col("llr") / F.sqrt(n) + F.lit(d) * F.log(n) + F.lit(e)
        return F.lit(1.0) / (1 + F.exp(-z))


def calibrated(peak: np.ndarray, ratios: np.ndarray, n_grams: np.ndarray, label: np.ndarray) -> Calibration:
    """Logistic regression by Newton's method; with one class alone, the untrained weights."""
    if len(label) == 0 or label.min() == label.max():
        return Calibration()
    n = np.maximum(n_grams, 1).astype(float)
    x = np.stack([peak, ratios / n, ratios / np.sqrt(n), np.log(n), np.ones(len(n))], axis=1)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (label - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(tuple(float(v) for v in w / scale))


def held_back(labels: DataFrame) -> Column:
    """Whether a row of ``labels`` (``doc_id``, each once) is kept from the counts, to calibrate the score."""
    h = F.xxhash64("doc_id")
    fourth = F.pmod(h, F.lit(CALIBRATION_SHARE)) == 0
    last = labels.filter(fourth).select(h.alias("h")).orderBy("h").limit(CALIBRATION_ROWS).agg(F.max("h")).first()[0]
    return fourth & (h <= last) if last is not None else F.lit(False)


def scores(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_grams, llr, peak, score`` for each row of ``docs``, learnt from ``labels`` (``doc_id, label`` 0 or 1).

    A quarter of the labelled documents, CALIBRATION_ROWS at most, is held back and calibrates the score of the model
    that all others are counted for.
    Null labels aren't learnt from; of two labels of one id the higher counts. A null text is empty: it has no
    n-gram, and the score that the calibration gives to nothing. Repeated rows each give a row; an empty table
    gives none; without both classes among the labels every score stays under one half.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    held = held_back(labels)
    counts = written(class_counts(docs, labels.filter(~held), order), "grams")
    model = written(kneser_ney(counts, order), "model")
    ratios = written(log_ratios(docs, model, order), "ratios")
    rows = ratios.join(labels.filter(held), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("peak", "llr", "n_grams", "label").toPandas()
    fitted = calibrated(rows["peak"].to_numpy(float), rows["llr"].to_numpy(float), rows["n_grams"].to_numpy(float), rows["label"].to_numpy(float))
    return ratios.withColumn("score", fitted.score())


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of the ``labels`` table, without the held-out fifth of the ids."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(in_fold(F.col("doc_id")) != 0)
