"""Quality rules on the shape of a text: Jensen-Shannon distance of its histograms to the references of languages.

A reference is what all texts of one language, as a column names it, look like together: the shares of character
classes, and of the language's most common words. A text keeps to a language if both of its own histograms lie
close enough to that reference; one that keeps to none is rejected. Texts too short for a histogram are not judged
by it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, text_chunks, written
from .words import hashed, joined, run_hashes, word_bounds, word_codes

CHUNK_BYTES = 1 << 19
#: Distinct words of which a task holds counts before it sends them on.
HELD_WORDS = 200_000
LOWER_CASE, UPPER_CASE, DIGIT, BEYOND, BLANK, STOP, MARK, SYMBOL = range(8)
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = LOWER_CASE, UPPER_CASE, DIGIT, BEYOND
    out[[0x20, *range(9, 14)]] = BLANK
    out[[ord(c) for c in ".,;:"]] = STOP
    out[list(SYMBOLS)] = SYMBOL
    return out


CLASSES = _classes()
#: Bytes that begin a code point.
LEADS = np.array([(c & 0xC0) != 0x80 for c in range(256)])
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rules:
    """Documented limits; distances are square roots of divergences to base 2, from 0 to 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    common_words: int = 32
    #: A language needs so many words in the corpus to be a reference.
    reference_words: int = 2000
    #: A text needs so many characters or words for its histogram to be compared.
    min_chars: int = 200
    min_common: int = 40
    max_class_distance: float = 0.28
    max_word_distance: float = 0.43


@dataclass(frozen=True)
class Reference:
    lang: str
    classes: np.ndarray
    words: dict[int, int]  # hash of a common word: its place
    shares: np.ndarray  # of the common words, and of all others


class Texts:
    """Arrays over some texts: bytes, words (their hashes, and those with A-Z lower-cased), and the text of each."""

    def __init__(self, texts: list[bytes]):
        self.data, self.ends = joined(texts)
        self.raw = np.frombuffer(self.data, np.uint8)
        self.start, self.end = word_bounds(self.raw)
        self.doc = np.searchsorted(self.ends, self.start, "right")
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.size = len(texts)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, and the distinct words."""
        code, distinct = word_codes(self.raw, self.start, self.end)
        return code, distinct.to_pylist()

    def hashes(self) -> np.ndarray:
        code, distinct = self.words
        return hashed(distinct)[code]

    def folded(self) -> np.ndarray:
        code, distinct = self.words
        return hashed([w.translate(FOLD) for w in distinct])[code]

    def class_counts(self) -> np.ndarray:
        """Code points of each class, for each text; the line feed put behind each text isn't counted."""
        lead = np.flatnonzero(LEADS[self.raw])
        owner = np.searchsorted(self.ends, lead, "right")
        own = lead + 1 != self.ends[np.minimum(owner, self.size - 1)]
        return np.bincount(owner[own] * 8 + CLASSES[self.raw[lead[own]]], minlength=8 * self.size).reshape(-1, 8)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def references(docs: DataFrame, rules: Rules = Rules()) -> list[Reference]:
    """One reference for each value of ``lang`` with enough words; rows with a null language or text don't count.

    Two passes over all texts: one sums character classes and words by language; the other counts every word, and of
    languages with enough of them the most common reach the driver (of equal counts the least by its bytes): so many
    rows for each ``reference_words`` words of the input at most. No cut into tasks changes either.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")

    def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Texts]]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in text_chunks(batch.column("text"), CHUNK_BYTES):
                own = langs[first : first + len(texts)]
                for lang in dict.fromkeys(own):
                    yield lang, Texts([t for t, x in zip(texts, own, strict=True) if x == lang])

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def out() -> pa.RecordBatch:
            words = [w.decode() for _, w in held]
            return pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in held], pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for lang, t in by_lang(batches):
            code, distinct = t.words
            for word, n in zip(distinct, np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
                key = lang, word.translate(FOLD)
                held[key] = held.get(key, 0) + n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, t in by_lang(batches):
            sums[lang] = sums.get(lang, 0) + np.append(t.class_counts().sum(axis=0), len(t.doc))
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    summed = docs.mapInArrow(by_class, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("i", "n"))
    sums = written(summed.groupBy("lang", "i").agg(F.sum("n").alias("n")), "sums")
    enough = sums.filter((F.col("i") == 8) & (F.col("n") >= rules.reference_words)).select("lang")
    counts = docs.mapInArrow(by_word, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).join(enough, "lang", "left_semi")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # each task sends its first ones only
    common: dict[str, list] = {}
    for row in sorted(counts.withColumn("i", place).filter(F.col("i") <= rules.common_words).collect(), key=lambda x: (x["lang"], x["i"])):
        common.setdefault(row["lang"], []).append(row)
    total = {(x["lang"], x["i"]): x["n"] for x in sums.join(enough, "lang", "left_semi").collect()}
    out = []
    for lang, top in common.items():
        classes, n_words = np.array([total[lang, i] for i in range(8)], float), total[lang, 8]
        n = np.array([x["n"] for x in top], float)
        shares = np.append(n, n_words - n.sum()) / n_words
        out.append(Reference(lang, classes / classes.sum(), dict(zip(hashes_of([x["word"] for x in top]).tolist(), range(len(top)), strict=True)), shares))
    return out


def hashes_of(words: list[str]) -> np.ndarray:
    """The same hashes as ``Texts.folded`` gives."""
    if not words:
        return np.zeros(0, np.uint64)
    t = Texts([w.encode() for w in words])
    return t.folded()


def _places(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each value stands among sorted keys; -1 for none."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _repeated(hashes: np.ndarray, doc: np.ndarray, window: int, size: int) -> np.ndarray:
    """Words of each text that lie in a window of words which stands twice or more in it."""
    if len(hashes) < window:
        return np.zeros(size, np.int64)
    inside = doc[: len(doc) - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    value, owner = run_hashes(hashes, window)[at], doc[at]
    order = np.lexsort((value, owner))
    same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    delta = np.zeros(len(hashes) + window + 1, np.int64)
    delta[at[twice]] = 1
    cover = np.cumsum(delta)
    cover[window:] -= cover[:-window].copy()
    return np.bincount(doc[cover[: len(doc)] > 0], minlength=size)


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("class_distance", "double"), ("word_distance", "double"), ("nearest", "string"), ("kept", "boolean"))


def judged(docs: DataFrame, known: list[Reference], rules: Rules = Rules()) -> DataFrame:
    """``docs`` (any columns; those named like the result's own are replaced) with the columns of ``COLUMNS``.

    ``class_distance``, ``word_distance`` and ``nearest`` belong to the language whose larger excess is least; a
    distance is null where the text is too short for it or no reference is known, and then doesn't count. Null
    texts have no words, and fail by ``min_words``. Ties between languages go to the first by name. Repeated rows
    are judged alike; an empty table gives an empty one.
    """
    names = [n for n, _ in COLUMNS]
    keep = [c for c in docs.columns if c not in names]

    plain = "text" in keep and docs.schema["text"].dataType.simpleString() == "string"  # then it travels once
    text = "text" if plain else free_name(docs, "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[dict] = [_judge(part, known, rules) for _, part in text_chunks(batch.column(text), CHUNK_BYTES)]
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
            columns = {c: batch.column(c) for c in keep}
            columns |= {n: pa.array([v for m in made for v in m[n]], kinds[k]) for n, k in COLUMNS}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields] + [f"{n} {k}" for n, k in COLUMNS])
    return docs.select(*keep, *([] if plain else [F.col("text").cast("string").alias(text)])).mapInArrow(rows, schema)


def _judge(texts: list[bytes], known: list[Reference], rules: Rules) -> dict[str, list]:
    t = Texts(texts)
    lead = np.zeros(len(t.raw) + 1, np.int64)
    np.cumsum(LEADS[t.raw], out=lead[1:])
    word_chars = np.bincount(t.doc, lead[t.end] - lead[t.start], minlength=t.size).astype(np.int64)
    repeated = _repeated(t.hashes(), t.doc, rules.repeat_window, t.size)
    classes = t.class_counts()
    failed = (t.n < rules.min_words) | (100 * repeated > rules.max_repeat_percent * t.n)
    chars = classes.sum(axis=1)
    folded = t.folded()
    best, near = np.full(t.size, np.inf), np.full(t.size, -1)
    found = np.full((t.size, 2), np.nan)
    for i, ref in enumerate(known):
        by_class = _distance(classes / np.maximum(chars, 1)[:, None], ref.classes)
        keys = np.array(sorted(ref.words), np.uint64)
        place = np.array([ref.words[k] for k in keys.tolist()], np.int64)
        at = _places(folded, keys)
        hit = at >= 0
        counts = np.bincount(t.doc[hit] * len(ref.shares) + place[at[hit]], minlength=t.size * len(ref.shares)).reshape(t.size, -1)
        counts[:, -1] = t.n - counts[:, :-1].sum(axis=1)
        by_word = _distance(counts / np.maximum(t.n, 1)[:, None], ref.shares)
        d = np.stack([np.where(chars >= rules.min_chars, by_class, np.nan), np.where(t.n >= rules.min_common, by_word, np.nan)], axis=1)
        excess = np.nan_to_num(d / [rules.max_class_distance, rules.max_word_distance], nan=0.0).max(axis=1)
        better = excess < best
        best[better], near[better], found[better] = excess[better], i, d[better]
    kept = ~failed & ((best <= 1) | (near < 0))
    value = lambda x: None if np.isnan(x) else float(x)
    return {
        "n_words": t.n.tolist(),
        "word_chars": word_chars.tolist(),
        "n_symbols": classes[:, SYMBOL].tolist(),
        "n_dup_lines": [_repeated_lines(x) for x in texts],
        "n_repeat_words": repeated.tolist(),
        "base_failed": failed.tolist(),
        "class_distance": [value(x) for x in found[:, 0].tolist()],
        "word_distance": [value(x) for x in found[:, 1].tolist()],
        "nearest": [known[i].lang if i >= 0 else None for i in near.tolist()],
        "kept": kept.tolist(),
    }


def quality(docs: DataFrame, rules: Rules = Rules(), reference_docs: DataFrame | None = None) -> DataFrame:
    """``judged`` by the references of ``reference_docs`` (``docs`` themselves by default); both have ``lang`` and ``text``."""
    return judged(docs, references(docs if reference_docs is None else reference_docs, rules), rules)
