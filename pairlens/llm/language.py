"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes up to `ORDER`: how often a byte followed a context, how many different bytes did. A byte
seen after its longest context costs -log2(c / (n + t)); a byte not seen there costs the escape, -log2(t / (n + t)), and is looked up after the
next shorter context, down to 8 bits for a byte that the language never had. The statistics stay as trained, so a text's exact code
length in every language is a sum of table entries: the tables hold, for each byte sequence that any language has, the whole cost with all escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.samples import labelled_sample
from pairlens.llm.workers import returned, small_batches

#: Longest context in bytes; contexts and the byte after them fit in 32 bits.
ORDER = 3
#: Labelled rows and bytes of each language that the trees are grown from, at most.
PER_LANGUAGE, MAX_BYTES = 600, 2_000_000
#: Bytes of texts that are coded at once, about: each takes some two hundred bytes of arrays. Rows that are decoded at once.
STEP, ROWS = 1 << 16, 128


def _grams(data: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The sequences of k + 1 bytes inside each text, as numbers."""
    if len(data) <= k:
        return np.zeros(0, np.uint32)
    n = len(data) - k
    out = np.zeros(n, np.uint32)
    for j in range(k + 1):
        out = (out << np.uint32(8)) | data[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, k + 1):
        crossing = ends[:-1] - j
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    return out[inside]


class Trees:
    """Cost tables of all languages: per order the sorted sequences and contexts, and bits per language."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.languages = sorted(texts)
        width = len(self.languages)
        counts = []
        for name in self.languages:
            data, ends = np.frombuffer(b"".join(texts[name]), np.uint8).astype(np.uint32), np.cumsum([len(t) for t in texts[name]])
            counts.append([np.unique(_grams(data, ends, k), return_counts=True) for k in range(ORDER + 1)])
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            grams = np.unique(np.concatenate([c[k][0] for c in counts] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(grams >> np.uint32(8)) if k else np.zeros(1, np.uint32)
            bits, escapes = np.zeros((len(grams), width), np.float32), np.zeros((len(contexts), width), np.float32)
            at = np.searchsorted(contexts, grams >> np.uint32(8)) if k else np.zeros(len(grams), np.int64)
            for j in range(width):
                own, number = counts[j][k]
                c = np.zeros(len(grams))
                c[np.searchsorted(grams, own)] = number
                n = np.bincount(at, c, len(contexts))
                t = np.bincount(at, c > 0, len(contexts))
                with np.errstate(divide="ignore"):
                    escapes[:, j] = np.where(n > 0, -np.log2(np.maximum(t, 1) / np.maximum(n + t, 1)), 0)
                    bits[:, j] = np.where(c > 0, -np.log2(np.maximum(c, 1) / (n + t)[at]), 0)
                if k:
                    shorter = self.bits[k - 1][np.searchsorted(self.grams[k - 1], grams & np.uint32((1 << 8 * k) - 1)), j]
                else:
                    shorter = np.float32(8)
                bits[:, j] += np.where(c > 0, 0, escapes[at, j] + shorter)
            self.grams.append(grams), self.bits.append(bits), self.contexts.append(contexts), self.escapes.append(escapes)

    def _add(self, total: np.ndarray, rows: np.ndarray, codes: np.ndarray, k: int) -> None:
        """Add the bits of sequences of k + 1 bytes to their rows; those that no language has escape to the next order."""
        grams = self.grams[k]
        if len(grams):
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            found = grams[at] == codes
            total[rows[found]] += self.bits[k][at[found]]
            rows, codes = rows[~found], codes[~found]
        if not len(rows):
            return
        context = codes >> np.uint32(8) if k else np.zeros(len(codes), np.uint32)
        at = np.minimum(np.searchsorted(self.contexts[k], context), max(len(self.contexts[k]) - 1, 0))
        if len(self.contexts[k]):
            known = self.contexts[k][at] == context
            total[rows[known]] += self.escapes[k][at[known]]
        if k:
            self._add(total, rows, codes & np.uint32((1 << 8 * k) - 1), k - 1)
        else:
            total[rows] += 8

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, int, int]] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), STEP):
                group.append((i, at, min(at + STEP, len(text))))
                size += group[-1][2] - at
                if size >= STEP:
                    self._code(texts, group, out)
                    group, size = [], 0
        self._code(texts, group, out)
        return out

    def _code(self, texts: list[bytes], group: list[tuple[int, int, int]], out: np.ndarray) -> None:
        if not group or not self.languages:
            return
        data = np.frombuffer(b"".join(texts[i][max(0, s - ORDER) : e] for i, s, e in group), np.uint8).astype(np.uint32)
        size = np.array([e - max(0, s - ORDER) for _, s, e in group])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        depth = np.minimum(np.arange(len(data)) - np.repeat(begin, size), ORDER)
        counted = np.ones(len(data), bool)
        for (_, s, _), b in zip(group, begin):
            counted[b : b + min(s, ORDER)] = False
        codes = data.copy()
        for j in range(1, ORDER + 1):
            codes[j:] |= data[:-j] << np.uint32(8 * j)
        total = np.zeros((len(data), len(self.languages)), np.float32)
        for k in range(ORDER + 1):
            rows = np.flatnonzero((depth == k) & counted)
            if len(rows):
                self._add(total, rows, codes[rows] & np.uint32((1 << 8 * (k + 1)) - 1), k)
        np.add.at(out, [i for i, _, _ in group], np.add.reduceat(total, begin, axis=0, dtype=np.float64))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> Trees:
    """Grow the trees from at most `per_language` rows and `max_bytes` bytes of each language.

    Rows without text or language are left out; a text that would exceed the bytes is skipped, and a language whose texts are all longer
    learns from the beginning of one.
    """
    texts: dict[str, list[bytes]] = {}
    for lang, text in labelled_sample(docs, docs.select(id_col, F.col(lang_col).alias("label")), id_col, text_col, per_language, max_bytes):
        texts.setdefault(lang, []).append(text.encode())
    return Trees(texts)


def identify(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and `lang_pred`, `lang_score` (its share among the languages, 0 to 1), `lang_bits` (bits per byte).

    From whole texts. A null text, one without a letter, or a model without languages gives `und`, score 0 and null bits.
    Columns of these names in the input are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_bits")
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the bytes it was grown from
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, ROWS):
                chunk = batch.slice(part, ROWS)
                texts = [t or "" for t in chunk.column(text_col).to_pylist()]
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(own.languages)
                data = [t.encode() if ok else b"" for t, ok in zip(texts, lettered)]
                pred, share, bits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
                if lettered.any():
                    lengths = own.code_lengths(data)
                    best = lengths.argmin(axis=1)
                    least = lengths.min(axis=1)
                    odds = np.where(lettered, 1 / np.exp2(least[:, None] - lengths).sum(axis=1), 0)
                    for i in np.flatnonzero(lettered):
                        pred[i], share[i], bits[i] = own.languages[best[i]], odds[i], float(least[i] / len(data[i]))
                yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(pred), pa.array(share), pa.array(bits, pa.float64())], names=[*chunk.schema.names, "lang_pred", "lang_score", "lang_bits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(returned(run), f"{fields}, lang_pred string, lang_score double, lang_bits double")
