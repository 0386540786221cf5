"""Language identification by unigrams of vocabulary pieces, summed over all segmentations of each word."""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import crc_of_id
from lagwise.llm.words import chunks

#: Longest piece of the public vocabulary, in characters with the mark for a word's start; no piece is cut off by it.
LONGEST = 16
#: Languages that a model may have: its table is this times the vocabulary.
MOST_LANGUAGES = 500
#: Words whose probabilities a worker remembers.
REMEMBERED = 300_000
#: Probability of a character that is no piece, in every language.
UNKNOWN = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


class Pieces:
    """All pieces of a sentencepiece vocabulary, found by the hash of their characters; ``longest`` is their most characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        self.pieces = sorted(set(usable))
        self.longest = max(map(len, self.pieces), default=1)
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for ch in p:
                h = (h * int(_BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[i] = h
        rest = np.arange(len(self.pieces))
        self._tables = []
        while len(rest):
            slot = self._slot(self.hashes[rest], len(self._tables))
            table = np.full(1 << _SLOTS, -1, np.int32)
            table[slot] = rest
            self._tables.append(table)
            rest = rest[table[slot] != rest]

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return ((h * np.uint64(2 * k + 0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _SLOTS)).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or the number of pieces."""
        out = np.full(h.shape, len(self.pieces), np.int32)
        for k, table in enumerate(self._tables):
            at = table[self._slot(h, k)]
            hit = (at >= 0) & (self.hashes[at] == h)
            out[hit] = at[hit]
        return out

    def lattice(self, words: list[str]):
        """Words by padded length: their numbers, lengths, and for each piece length the piece that starts at each place."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        padded = 1 << np.ceil(np.log2(np.maximum(lengths, 4))).astype(np.int64)
        for size in np.unique(padded).tolist():
            group = np.flatnonzero(padded == size)
            for at in range(0, len(group), step := max(1, (1 << 18) // size)):
                part = group[at : at + step]
                text = "".join(words[i].ljust(size, "\0") for i in part.tolist())
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size).astype(np.uint64) + np.uint64(1)
                h, found = np.zeros_like(codes), []
                for n in range(1, min(self.longest, size) + 1):
                    h = h[:, : size - n + 1] * _BASE + codes[:, n - 1 :]
                    found.append(self.find(h))
                yield part, lengths[part], found


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _forward(found, probabilities: np.ndarray):
    """Scaled sums over the segmentations of each prefix, and the logarithm of the scale, per place and language."""
    n, size = found[0].shape
    none = len(probabilities) - 1
    sums = [np.ones((n, probabilities.shape[1]))]
    logs = [np.zeros((n, 1))]
    for end in range(1, size + 1):
        total = sums[end - 1] * np.maximum(probabilities[found[0][:, end - 1]], UNKNOWN)
        for k in range(2, min(len(found), end) + 1):
            piece = found[k - 1][:, end - k]
            at = np.flatnonzero(piece < none)  # few places have a long piece
            if len(at):
                total[at] += sums[end - k][at] * probabilities[piece[at]] * np.exp(logs[end - k][at] - logs[end - 1][at])
        scale = np.maximum(total.max(axis=1, keepdims=True), 1e-300)
        sums.append(total / scale)
        logs.append(logs[end - 1] + np.log(scale))
    return sums, logs


def word_scores(pieces: Pieces, words: list[str], probabilities: np.ndarray) -> np.ndarray:
    """log P(word | language): one row per word, summed over all ways to cut it into pieces."""
    out = np.empty((len(words), probabilities.shape[1]))
    for part, lengths, found in pieces.lattice(words):
        sums, logs = _forward(found, probabilities)
        rows = np.arange(len(part))
        out[part] = np.log(np.maximum(np.stack(sums)[lengths, rows], 1e-300)) + np.stack(logs)[lengths, rows]
    return out


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """How often each piece is used on average over the words' segmentations, all pieces drawn by ``prior``.

    ``weights``: a row per word, a column per language; so is the result, with a row per piece.
    """
    out = np.zeros((len(pieces.pieces) + 1, weights.shape[1]))
    for part, lengths, found in pieces.lattice(words):
        n, size = found[0].shape
        use = [np.maximum(prior[f], UNKNOWN) if k == 0 else prior[f] for k, f in enumerate(found)]
        ahead, ahead_log = (np.stack(x)[:, :, 0] for x in _forward(found, prior[:, None]))
        behind, behind_log = np.zeros((size + 1, n)), np.zeros((size + 1, n))
        for at in range(size, -1, -1):
            after = behind_log[min(at + 1, size)]
            total = np.zeros(n)
            for k in range(1, min(len(use), size - at) + 1):
                i = np.flatnonzero(use[k - 1][:, at])
                total[i] += behind[at + k][i] * use[k - 1][i, at] * np.exp(behind_log[at + k][i] - after[i])
            total = np.where(lengths == at, 1.0, total)
            scale = np.where((lengths > at) & (total > 0), total, 1.0)
            behind[at], behind_log[at] = total / scale, np.where(lengths > at, after + np.log(scale), 0.0)
        whole = behind_log[0] + np.log(np.maximum(behind[0], 1e-300))
        for k, f in enumerate(found):
            j, i = np.nonzero((f.T < len(pieces.pieces)) | (k == 0))
            shares = ahead[j, i] * use[k][i, j] * behind[j + k + 1, i]
            j, i, shares = (x[shares > 0] for x in (j, i, shares))
            weight = shares * np.exp(ahead_log[j, i] + behind_log[j + k + 1, i] - whole[i])
            for lang in range(weights.shape[1]):
                out[:, lang] += np.bincount(f[i, j], weight * weights[part[i], lang], len(out))
    return out


def _marked(words: list[bytes]) -> list[str]:
    return ["▁" + w.decode().lower() for w in words]


def learn(docs: DataFrame, vocabulary: str) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a row per piece, a column per language) of ``docs(lang, text)``.

    One expectation step from equal piece probabilities over all words of all texts, summed in each task first. What
    reaches the driver has at most ``MOST_LANGUAGES`` times the vocabulary's size. Unseen pieces get half a use.
    """
    langs = [r.lang for r in docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(langs)
    number = {x: i for i, x in enumerate(langs)}

    def of(batches):
        pieces, total = _pieces(vocabulary), 0.0
        prior = np.full(len(pieces.pieces) + 1, 1 / max(1, len(pieces.pieces)))
        prior[-1] = 0
        for c in chunks(batches):
            place: dict[bytes, int] = {}
            at = np.fromiter((place.setdefault(w, len(place)) for w in c.words), np.int64, len(c.words))
            lang = np.array([number[x] for x in c.rest[0].to_pylist()], np.int64)[c.document_of()]
            weights = np.bincount(at * len(langs) + lang, minlength=len(place) * len(langs)).reshape(-1, len(langs)).astype(float)
            total = total + expected_counts(pieces, _marked(list(place)), weights, prior)
        if isinstance(total, np.ndarray):
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["piece", "lang", "uses"])

    rows = docs.select("doc_id", "text", "lang").mapInArrow(of, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
    counts = np.zeros((len(_pieces(vocabulary).pieces) + 1, len(langs)))
    counts[rows["piece"], rows["lang"]] = rows["uses"]
    table = counts + 0.5
    table /= table[:-1].sum(axis=0)
    table[-1] = 0
    return langs, table


class _Scorer:
    """Word scores under one model, remembered within bounds."""

    def __init__(self, vocabulary: str, table: np.ndarray):
        self._pieces, self._table = _pieces(vocabulary), table
        self._place: dict[bytes, int] = {}
        self._scores = np.zeros((0, table.shape[1]), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self._place]
        if len(self._place) + len(new) > REMEMBERED:
            self._place, self._scores, new = {}, self._scores[:0], list(set(words))
        if new:
            new.sort()
            self._place.update(zip(new, range(len(self._place), len(self._place) + len(new))))
            self._scores = np.concatenate([self._scores, word_scores(self._pieces, _marked(new), self._table).astype(np.float32)])
        return self._scores[np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))]


_SCORERS: dict[int, tuple[str, _Scorer]] = {}


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, vocabulary: str) -> DataFrame:
    """``doc_id, <others>, lang_pred, score``: the likeliest language of each whole text and its share of all.

    ``docs``: doc_id, text and any others. ``und``, 0 for null, for texts without a letter, and if no language was learned.
    """
    model, key = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    others = docs.columns[2:]

    def of(batches):
        held = _SCORERS.get(0)
        if held is None or held[0] != key:
            _SCORERS[0] = held = (key, _Scorer(vocabulary, model.value))
        for c in chunks(batches):
            n = len(c.texts)
            names, best = ["und"] * n, np.zeros(n)
            if langs:
                sums = np.zeros((len(c.words) + 1, len(langs)))
                if c.words:
                    np.cumsum(held[1].of(c.words), axis=0, dtype=np.float64, out=sums[1:])
                total = sums[c.first[1:]] - sums[c.first[:-1]]
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                top = share.argmax(axis=1)
                for i, t in enumerate(c.texts):
                    if t and any(map(str.isalpha, t.decode())):
                        names[i], best[i] = langs[top[i]], share[i, top[i]]
            yield pa.RecordBatch.from_arrays([c.ids, *c.rest, pa.array(names, pa.string()), pa.array(best)], ["doc_id", *others, "lang_pred", "score"])

    kind = ", ".join(f"{n} {t}" for n, t in docs.dtypes if n != "text") + ", lang_pred string, score double"
    return docs.mapInArrow(of, kind)


def identify(docs: DataFrame, vocabulary: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``.

    Learns from text and lang of rows whose fold, crc32 of the doc_id's text modulo ``folds``, is not ``held_out`` and
    whose lang is not null; nothing but the text is used to predict. Rows that repeat a doc_id or have none are rows of
    their own (no id: empty text for the fold). An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (crc_of_id() % folds == held_out).alias("held_out"), F.col("lang").cast("string").alias("lang"),
    )
    langs, table = learn(rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"), vocabulary)
    return predict(rows.drop("lang"), langs, table, vocabulary)
