"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A passage is a bag: a word that it repeats counts once. A word's vector is the mean of the vectors of its character n-grams and of itself (hashed into `BUCKETS` rows), a passage's the
mean of its words', and a two-class linear softmax reads that mean, times the passage length (so that one word can decide). A word never seen shares the n-grams of the words it is derived from or
misspelt after. A document scores as its most toxic passage, so that a long text does not dilute a few words; training picks
that passage anew in every epoch.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.samples import sample_rows
from pairlens.llm.workers import returned, small_batches

BUCKETS, WIDTH, PASSAGE = 1 << 16, 8, 32
#: Labelled rows of each label that the classifier is fitted on, at most.
PER_LABEL = 3000
EPOCHS, BATCH, RATE, VECTOR_RATE, FLOOR = 6, 128, 0.1, 5.0, 1e-4
#: Small samples are gone through more often, until so many batches have been seen.
UPDATES = 280
#: Buckets met in fewer training texts are left at zero: they would only memorise their texts.
MIN_TEXTS = 5
#: Words whose scores are summed at once in training.
CHUNK = 1 << 16
#: Words whose score a task remembers, and the characters of the longest; when full, it starts afresh.
MAX_WORDS, MAX_CHARS = 300_000, 24
_WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Buckets of the word in angle brackets and of its n-grams of 3 to 5 characters (UTF-16 units)."""
    marked = f"<{word}>".encode("utf-16-le")
    size, last = len(marked), BUCKETS - 1
    return [zlib.crc32(marked) & last, *(zlib.crc32(marked[i : i + n]) & last for n in (6, 8, 10) for i in range(0, size - n + 1, 2))]


def passages(n: int) -> np.ndarray:
    """First words of the passages of a text of n words; a last one of under half the length joins the one before."""
    starts = np.arange(0, max(n, 1), PASSAGE)
    return starts[:-1] if len(starts) > 1 and n - starts[-1] < PASSAGE // 2 else starts


class Model:
    """The trained classifier, folded into a score per bucket (the difference of the two classes' logits) and a bias."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias
        self.values = table.tolist()
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.words.get(word)
        if value is None:
            grams = subwords(word)
            value = sum(map(self.values.__getitem__, grams)) / len(grams)
            if len(word) <= MAX_CHARS:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[word] = value
        return value

    def score(self, text: str | None) -> float:
        """Probability of the most toxic passage; a text without words has the bias alone."""
        words = _WORD.findall((text or "").lower())
        if not words:
            return 1 / (1 + math.exp(-self.bias))
        starts = passages(len(words)).tolist()
        best = max(sum(map(self.word, set(words[s:e]))) / (e - s) for s, e in zip(starts, [*starts[1:], len(words)]))
        return 1 / (1 + math.exp(-min(max(PASSAGE * best + self.bias, -500), 500)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit embeddings and softmax together by Adagrad; constant where there are no two classes."""
    target = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        prior = (target.sum() + 0.5) / (len(target) + 1)
        return Model(np.zeros(BUCKETS, np.float32), math.log(prior / (1 - prior)))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    # Growing machine arrays, no lists of lists: a sample of many different words stays small.
    ids, ends, grams, sizes = [], [], array("i"), array("i")
    for text in texts:
        own = array("i")
        for w in _WORD.findall(text.lower()) or [""]:
            k = vocabulary.get(w)
            if k is None:
                k = vocabulary[w] = len(vocabulary)
                parts = subwords(w)
                grams.extend(parts)
                sizes.append(len(parts))
            own.append(k)
        ids.append(np.frombuffer(own, np.int32))
        ends.append(len(own))
    n_words = len(vocabulary)
    vocabulary.clear()
    flat, size = np.frombuffer(grams, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    words, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(ends)])
    starts = [passages(n) for n in ends]
    in_passage = np.repeat(np.arange(sum(map(len, starts))), np.concatenate([np.diff(np.append(s, n)) for s, n in zip(starts, ends)]))
    first_use = np.zeros(len(words), np.float32)
    for k in range(len(texts)):
        own = slice(bounds[k], bounds[k + 1])
        first_use[bounds[k] + np.unique((in_passage[own] - in_passage[bounds[k]]) * np.int64(n_words) + words[own], return_index=True)[1]] = 1
    of_doc = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate([s + b for s, b in zip(starts, bounds)])
    stop = np.append(start[1:], len(words))
    head = np.concatenate([[0], np.cumsum([len(s) for s in starts])[:-1]])

    spread = np.zeros(BUCKETS, np.int64)
    for own in ids:
        used = np.unique(own)
        spread[np.unique(np.concatenate([flat[first[w] : first[w] + size[w]] for w in used]))] += 1
    known = spread >= MIN_TEXTS
    vectors = rng.normal(0, 0.01, (BUCKETS, WIDTH)) * known[:, None]
    weights, bias = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    sums = [np.full_like(x, FLOOR) for x in (vectors, weights, bias)]
    balance = np.where(target > 0, (target == 0).sum() / (target > 0).sum(), 1.0) ** 0.5
    batches = max(1, len(texts) // BATCH)
    for epoch in range(max(EPOCHS, -(-UPDATES // batches))):
        if epoch < 2:  # any passage, as there is no model yet
            chosen = head + (rng.random(len(head)) * np.bincount(of_doc)).astype(int)
        else:
            table = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
            value = np.empty(n_words, np.float32)
            for a in range(0, n_words, CHUNK):
                b = min(a + CHUNK, n_words)
                value[a:b] = np.add.reduceat(table[flat[first[a] : first[b] if b < n_words else None]], first[a:b] - first[a], dtype=np.float64) / size[a:b]
            mean = np.add.reduceat(value[words] * first_use, start, dtype=np.float64) / (stop - start)
            by = np.lexsort((-mean, of_doc))
            chosen = by[head]
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            own = chosen[batch]
            length = stop[own] - start[own]
            member = np.repeat(np.arange(len(own)), length)
            place = np.repeat(start[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            place, member, length = place[first_use[place] > 0], member[first_use[place] > 0], length[member[first_use[place] > 0]]
            word = words[place]
            count = size[word]
            gram = flat[np.repeat(first[word] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            part = np.repeat(1 / (count * length), count)
            row = np.repeat(member, count)
            used, at = np.unique(gram, return_inverse=True)
            # The batch's documents by the buckets they use: one small matrix for both directions.
            share = np.zeros((len(own), len(used)))
            np.add.at(share, (row, at), part)
            hidden = PASSAGE * (share @ vectors[used])
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), target[batch].astype(int)] -= 1
            p *= balance[batch, None] / len(own)
            steps = (PASSAGE * (share.T @ (p @ weights.T)), hidden.T @ p, p.sum(axis=0))
            sums[0][used] += steps[0] ** 2
            vectors[used] -= VECTOR_RATE * steps[0] / np.sqrt(sums[0][used]) * known[used, None]
            for x, total, step in ((weights, sums[1], steps[1]), (bias, sums[2], steps[2])):
                total += step**2
                x -= RATE * step / np.sqrt(total)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Train on at most `per_label` documents of each label (0 or 1, in `labels` by id); those without label or text are left out.

    The sample is bounded and is learnt from in one task; the driver gets the model alone, a number per bucket.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("label"))
    rows = sample_rows(docs, known, id_col, text_col, per_label).repartition(1).sortWithinPartitions("at").select(F.col("label").cast("int"), "text_part")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            texts += [t.as_py().decode("utf-8", "ignore") for t in batch.column(1)]
        model = train(texts, marks)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()]), pa.array([model.bias])], names=["table", "bias"])

    got = rows.mapInArrow(returned(learn), "table binary, bias double").first()
    if got is None:  # no labelled row
        return train([], [])
    table, bias = got
    return Model(np.frombuffer(bytes(table), np.float32), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` and `toxicity` (0 to 1), from whole texts. A null or wordless text scores by the bias alone.

    A column `toxicity` of the input is replaced.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # one value per bucket
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                chunk = batch.slice(part, 1024)
                yield chunk.append_column("toxicity", pa.array([own.score(t.as_py()) for t in chunk.column(text_col)], pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(returned(run), f"{fields}, toxicity double")
