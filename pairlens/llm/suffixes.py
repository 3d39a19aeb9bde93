"""Exact substring deduplication by a sparse suffix array.

Sorting every suffix of a corpus would move many times its size, so only suffixes at anchors are sorted. An anchor is the byte
position whose `token` bytes hash lowest among the token starts of some `length`-byte window (leftmost if tied): equal windows
have equal anchors at equal places, wherever they stand, so comparing the anchors' surroundings finds every repeated window.

1. Anchors' token hashes are counted per hash range; tokens of a single document go.
2. The suffixes that remain (with the bytes before them that a window can reach) are range-partitioned by their leading
   token at sampled splitters. Suffixes that share the token always share a bucket, so no match crosses a border.
3. A bucket sorts its suffixes, and the reversed bytes before them, by multikey sorts (one machine word after another), and the lengths of the
   common prefixes of neighbours tell which windows are equal. A window goes if a document with a smaller id has it too.
4. Marks go back to the documents, where the windows' bytes are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.workers import returned, small_batches

#: A quarter of the bytes of one worker step; window starts whose anchors are sought at once, with some ten numbers each; anchors whose surroundings are looked up at once.
STEP, WINDOWS, ROWS = 1 << 20, 1 << 17, 1 << 13
#: Documents whose anchors the splitters are taken from; they only balance the buckets.
SAMPLE = 2000
_NONE = np.zeros(0, dtype=np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes first: sorted or small values then compress well. Deflated at once."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes(), 1)


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


class Anchors:
    """Anchor positions of byte strings, for windows of `length` bytes and tokens of `token` bytes."""

    def __init__(self, length: int, token: int) -> None:
        if not 1 <= token <= length < 256:
            raise ValueError("1 <= token <= length < 256 is needed")
        self.length, self.token, self.span = length, token, length - token + 1
        odd, powers = 0x9E3779B97F4A7C15, {}
        for k in range(9):
            powers[1 << k] = np.uint64(pow(odd, 1 << k, 1 << 64))
        self.powers, self.odd = powers, np.uint64(odd)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of the `token` bytes from each position, by doubling; positions without so many bytes are left out."""
        width, whole, part = 1, data.astype(np.uint64) + np.uint64(1), None
        rest, got = self.token, 0
        while True:
            if rest & width:
                if part is None:
                    part, got = whole, width
                else:
                    n = len(whole) - got
                    part, got = part[:n] * self.powers[width] + whole[got : got + n], got + width
            if width * 2 > rest:
                break
            n = len(whole) - width
            whole, width = whole[:n] * self.powers[width] + whole[width:], width * 2
        part = part ^ (part >> np.uint64(32))
        part *= self.odd
        part ^= part >> np.uint64(29)
        return part

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: byte strings one after another; ends: where each ends. Returns per anchor its position, its hash and the
        distances back to the last and first window start that it serves."""
        found = []
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for lo in range(0, max(1, len(data)), WINDOWS):
            found.append(self._part(data, starts, ends, lo, min(lo + WINDOWS, len(data) - self.length + 1)))
        position, hashes, first, last = (np.concatenate(x) for x in zip(*found))
        return position, hashes, position - last, position - first

    def _part(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start in [lo, hi). One that serves windows on both sides of a border is listed twice."""
        if hi <= lo:
            return _NONE, _NONE.astype(np.uint64), _NONE, _NONE
        hashes = self._hashes(data[lo : hi + self.length - 1])
        least = (hashes & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < self.span:
            step = min(width, self.span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        whole = np.ones(hi - lo, dtype=bool)  # windows inside one document
        near = slice(np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi + self.length))
        for s, e in zip(starts[near], ends[near]):
            whole[max(e - self.length + 1, s, lo) - lo : max(e - lo, 0)] = False
        window = np.flatnonzero(whole)
        at = at[window]
        if not len(at):
            return _NONE, _NONE.astype(np.uint64), _NONE, _NONE
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        stop = np.concatenate([new[1:], [len(at)]]) - 1
        return at[new] + lo, hashes[at[new]], window[new] + lo, window[stop] + lo


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Groups of rows of some MB: ids, row tags and texts. Rows without an id take no part."""
    ids, tags, texts, size = [], [], [], 0
    for batch in batches:
        for doc, tag, text in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
            if doc is None or (data := text.as_py()) is None:
                continue
            ids.append(doc), tags.append(tag), texts.append(data)
            size += len(data)
            if size >= 4 * STEP:
                yield np.array(ids, np.int64), np.array(tags, np.int64), texts
                ids, tags, texts, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(tags, np.int64), texts


def _surroundings(data: np.ndarray, position: np.ndarray, back: np.ndarray, fore: np.ndarray, before: int, after: int) -> np.ndarray:
    """Bytes from `before` left of each position to `after` right of it; those out of [position - back, position + fore) are 0."""
    at = np.arange(-before, after)
    out = np.empty((len(position), len(at)), np.uint8)
    for lo in range(0, len(position), ROWS):  # the index takes eight bytes a byte
        own = slice(lo, lo + ROWS)
        out[own] = data[np.clip(position[own, None] + at, 0, len(data) - 1)]
        out[own][(at < -back[own, None]) | (at >= fore[own, None])] = 0
    return out


def _word(rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th machine word of each row of bytes, big-endian; the last one is filled up with zeros."""
    part = rows[:, 8 * k : 8 * k + 8]
    padded = np.zeros((len(rows), 8), np.uint8)
    padded[:, : part.shape[1]] = part
    return padded.view(">u8").ravel().astype(np.uint64)


def _multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and the length of the common prefix of each with the one before it (the first: 0).

    Sorts by the first machine word, then by the next only where rows still tie. Holds a word or two of each row beside the rows.
    """
    word = _word(rows, 0)
    order = np.argsort(word, kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(1, -(-rows.shape[1] // 8)):
        word = word[order]
        same &= word[1:] == word[:-1]  # rows that tie in all words so far change places only with each other
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        group = np.cumsum(~np.concatenate([[False], same]))[tied]
        word = _word(rows, k)
        order[tied] = order[tied][np.lexsort((word[order[tied]], group))]
    common = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), ROWS):
        own = order[lo - 1 : lo + ROWS]
        sorted_rows = rows[own]
        differ = sorted_rows[1:] != sorted_rows[:-1]
        common[lo : lo + ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def repeated_windows(around: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray, before: int, length: int) -> np.ndarray:
    """Bit o of an anchor's mark is set if its window starting o bytes before it also stands in a document with a smaller id.

    around: bytes from `before` left of the anchor to `length` right of it; near..far: the o of its windows.
    """
    n, marks = len(doc), np.zeros(len(doc), np.uint64)
    if not n:
        return marks
    order, common = _multikey_sort(np.ascontiguousarray(around[:, before:]))
    left_order, left_common = _multikey_sort(np.ascontiguousarray(around[:, :before][:, ::-1]))
    for o in range(before + 1):
        own = np.flatnonzero((near <= o) & (o <= far))
        if not len(own):
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[order] = np.cumsum(common < length - o)
        left[left_order] = np.cumsum(left_common < o) if o else 1
        key = right[own] * (n + 1) + left[own]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[own][by], new), np.diff(np.concatenate([new, [len(by)]])))
        hit = own[by[doc[own][by] > least]]
        marks[hit] |= np.uint64(1 << o)
    return marks


class SubstringDedup:
    """The stages of the deduplication for windows of `length` bytes."""

    FIELDS = ["target", "kind", "id", "tag", "data"]
    BLOB = "target int, kind int, id bigint, tag bigint, data binary"
    KEPT = "id bigint, kept binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>"

    def __init__(self, length: int, token: int, tasks: int, whole_characters: bool = False) -> None:
        self.anchors, self.length, self.tasks, self.whole_characters = Anchors(length, token), length, tasks, whole_characters
        self.before = self.anchors.span - 1
        if self.before > 63:
            raise ValueError("length - token must be 63 at most")

    # 1: token hashes with their documents, by hash range; then the hashes of several documents, by document.

    def tokens(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(range of the hash, sorted hashes, documents), a few MB at a time."""
        for ids, _, texts in _documents(batches):
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            position, hashes, _, _ = self.anchors.of(data, ends)
            doc = ids[np.searchsorted(ends, position, side="right")]
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
            hashes, doc = hashes[fresh], doc[fresh]
            yield from self._emit((hashes >> np.uint64(40)).astype(np.int64) * self.tasks >> 24, hashes, doc)

    def _emit(self, target: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = []
        border = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else _NONE
        for s, e in zip(border, np.concatenate([border[1:], [len(target)]])):
            rows.append((int(target[s]), _planes(hashes[s:e]), _planes(doc[s:e])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["target", "hashes", "docs"])

    def shared_tokens(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task's hash ranges: hashes of two documents or more go to each of their documents' tasks."""
        parts: dict[int, list] = {}
        for batch in batches:
            for target, hashes, docs in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(target, []).append((hashes, docs))
        while parts:
            own = parts.popitem()[1]
            hashes = np.concatenate([_unplanes(h, "<u8") for h, _ in own])
            doc = np.concatenate([_unplanes(d, "<i8") for _, d in own])
            del own
            order = np.argsort(hashes, kind="stable")
            hashes, doc = hashes[order], doc[order]
            del order
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            mixed = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
            several = np.repeat(mixed, np.diff(np.append(new, len(hashes))))
            hashes, target = hashes[several], doc[several] % self.tasks
            del doc, new, mixed, several
            order = np.lexsort((hashes, target))
            hashes, target = hashes[order], target[order]
            border = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else _NONE
            rows = [(int(target[s]), _planes(np.unique(hashes[s:e]))) for s, e in zip(border, np.concatenate([border[1:], [len(target)]]))]
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=self.FIELDS)

    def compressed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, and `rest` if there is one, on their way to the task of their document (id mod tasks; null ids with the tag)."""
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                chunk = batch.slice(part, 512)
                ids, tags = chunk.column("id").to_pylist(), chunk.column("tag").to_pylist()
                data = [None if (t := x.as_py()) is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for x in chunk.column("text")]
                target = [(t if i is None else i) % self.tasks for i, t in zip(ids, tags)]
                columns = [pa.array(target, pa.int32()), pa.array([1] * len(ids), pa.int32()), chunk.column("id"), chunk.column("tag"), pa.array(data, pa.binary())]
                rest = ["rest"] if "rest" in chunk.schema.names else []
                yield pa.RecordBatch.from_arrays([*columns, *map(chunk.column, rest)], names=self.FIELDS + rest)

    @staticmethod
    def _texts(batches: Iterator[pa.RecordBatch], marks: list) -> Iterator[pa.RecordBatch]:
        """Texts of one task, unpacked, a few MB at a time; the other rows, which come first, are put into `marks`."""
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            others = kinds.count(0)
            marks.extend(zip(batch.column("target").slice(0, others).to_pylist(), batch.column("data").slice(0, others).to_pylist()))
            texts, size, start = [], 0, others
            for row in range(others, len(kinds)):
                blob = batch.column("data")[row].as_py()
                text = None if blob is None else codec.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)
                texts.append(text)
                size += len(text or b"")
                if size > 4 * STEP or row + 1 == len(kinds):
                    part = batch.slice(start, len(texts))
                    names = [c for c in ("id", "tag", "rest") if c in part.schema.names]
                    columns = [part.column(c) for c in names]
                    columns.insert(2, pa.array(texts, pa.binary()))
                    names.insert(2, "text")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    texts, size, start = [], 0, row + 1

    # 2: surroundings of the anchors that several documents have, by range of the leading token.

    def suffixes(self, splitters: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks: list = []
            known = None
            for ids, tags, texts in _documents(self._texts(batches, marks)):
                if known is None or marks:
                    fresh = [_unplanes(d, "<u8") for _, d in marks]
                    known = np.unique(np.concatenate([*fresh, *([known] if known is not None else []), np.zeros(0, np.uint64)]))
                    marks.clear()
                data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
                position, hashes, near, far = self.anchors.of(data, ends)
                where = np.searchsorted(known, hashes)
                found = np.flatnonzero(known[np.minimum(where, len(known) - 1)] == hashes) if len(known) else _NONE
                position, near, far = position[found], near[found], far[found]
                row = np.searchsorted(ends, position, side="right")
                around = _surroundings(data, position, far, self.length - near, self.before, self.length)
                start = np.concatenate([[0], ends[:-1]])[row]
                yield from self._local(around, ids[row], tags[row], position - start, near, far, splitters)

        return run

    def _local(self, around: np.ndarray, doc: np.ndarray, tag: np.ndarray, position: np.ndarray, near: np.ndarray, far: np.ndarray, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Combines equal surroundings before the shuffle: only the smallest id's goes on, the others' windows all go."""
        whole = np.concatenate([around, near[:, None].astype(np.uint8), far[:, None].astype(np.uint8)], axis=1)
        order, common = _multikey_sort(np.ascontiguousarray(np.roll(whole, -self.before, axis=1)))
        if not len(order):
            return
        new = np.flatnonzero(common < whole.shape[1])
        size = np.diff(np.concatenate([new, [len(order)]]))
        least = np.repeat(np.minimum.reduceat(doc[order], new), size)
        later = doc[order] > least
        known = order[later]
        if len(known):
            marks = (np.uint64(2) << far[known].astype(np.uint64)) - (np.uint64(1) << near[known].astype(np.uint64))
            yield self._marks(doc[known], tag[known], position[known], marks)
        rest = order[~later]
        lead = np.ascontiguousarray(around[rest][:, self.before : self.before + self.anchors.token])
        target = np.searchsorted(splitters, lead.view(f"S{self.anchors.token}").ravel(), side="right") if len(splitters) else np.zeros(len(rest), np.int64)
        border = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(rest) else _NONE
        rows, codec = [], pa.Codec("zstd", 9)
        for s, e in zip(border, np.concatenate([border[1:], [len(rest)]])):
            own = rest[s:e]
            packed = b"".join(len(x).to_bytes(8, "little") + x for x in (_planes(doc[own]), _planes(tag[own]), _planes(position[own]), codec.compress(whole[own].tobytes(), asbytes=True)))
            rows.append((int(target[s]), packed))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["target", "kind", "data"])

    def _marks(self, doc: np.ndarray, tag: np.ndarray, position: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        """Marks by the task of their documents, as rows of kind 0."""
        target = doc % self.tasks
        order = np.lexsort((position, doc, target))
        rows, sorted_target = [], target[order]
        border = np.flatnonzero(np.concatenate([[True], sorted_target[1:] != sorted_target[:-1]]))
        for s, e in zip(border, np.concatenate([border[1:], [len(order)]])):
            own = order[s:e]
            rows.append((int(sorted_target[s]), b"".join(len(x).to_bytes(8, "little") + x for x in (_planes(doc[own]), _planes(tag[own]), _planes(position[own]), _planes(marks[own])))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["target", "kind", "data"])

    @staticmethod
    def _fields(packed: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(packed):
            n = int.from_bytes(packed[at : at + 8], "little")
            out.append(packed[at + 8 : at + 8 + n])
            at += 8 + n
        return out

    # 3: buckets.

    def buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for target, kind, data in zip(*(batch.column(c).to_pylist() for c in ("target", "kind", "data"))):
                if kind:
                    parts.setdefault(target, []).append(self._fields(data))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())], names=self.FIELDS)
        width = self.before + self.length
        while parts:
            own = parts.popitem()[1]
            parts_of = [[_unplanes(x[k], "<i8") for x in own] for k in range(3)]
            codec = pa.Codec("zstd", 9)
            whole, at = np.empty((sum(map(len, parts_of[0])), width + 2), np.uint8), 0
            for x, d in zip(own, parts_of[0]):
                block = codec.decompress(x[3], decompressed_size=len(d) * (width + 2), asbytes=True)
                whole[at : at + len(d)] = np.frombuffer(block, np.uint8).reshape(-1, width + 2)
                at += len(d)
            doc, tag, position = map(np.concatenate, parts_of)
            del own, parts_of
            marks = repeated_windows(whole[:, :width], doc, whole[:, width].astype(np.int64), whole[:, width + 1].astype(np.int64), self.before, self.length)
            hit = np.flatnonzero(marks)
            if len(hit):
                found = self._marks(doc[hit], tag[hit], position[hit], marks[hit])
                n = found.num_rows
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), found.column(2)], names=self.FIELDS)

    # 4: the documents without their repeated bytes.

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list = []
        table = None
        for batch in self._texts(batches, marks):
            if table is None or marks:
                fields = [self._fields(d) for _, d in marks]
                fresh = [np.concatenate([*(_unplanes(f[k], t) for f in fields), *([table[k]] if table else []), np.zeros(0, t)]) for k, t in enumerate(("<i8", "<i8", "<i8", "<u8"))]
                order = np.lexsort((fresh[1], fresh[0]))
                table = [x[order] for x in fresh]
                marks.clear()
            out = [self._kept(doc, tag, text, table) for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)))]
            spans = pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64()), spans]
            rest = batch.schema.names[3:]
            yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, rest)], names=["id", "kept", "n_bytes", "spans", *rest])

    def _kept(self, doc: int | None, tag: int, text: bytes | None, table: list[np.ndarray]) -> tuple[bytes, list[dict], int]:
        if text is None or doc is None:
            return text or b"", [], len(text or b"")
        lo, hi = np.searchsorted(table[0], doc), np.searchsorted(table[0], doc, side="right")
        lo, hi = lo + np.searchsorted(table[1][lo:hi], tag), lo + np.searchsorted(table[1][lo:hi], tag, side="right")
        if lo == hi:
            return text, [], len(text)
        bits = (table[3][lo:hi, None] >> np.arange(self.before + 1, dtype=np.uint64)) & np.uint64(1)
        row, back = np.nonzero(bits)
        start = table[2][lo:hi][row] - back
        depth = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + self.length, minlength=len(text) + 1)
        gone = np.cumsum(depth[:-1]) > 0
        data = np.frombuffer(text, np.uint8)
        if self.whole_characters:  # UTF-8: a character goes if all its bytes do
            first = np.flatnonzero((data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
        gone = np.concatenate([[0], gone, [0]]).astype(np.int8)
        edge = np.diff(gone)
        spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]
        return data[gone[1:-1] == 0].tobytes(), spans, len(text)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as Arrow batches carry it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def remove_repeats(docs: DataFrame, length: int = 50, token: int = 24, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """Cut every byte covered by a `length`-byte string that also starts in a document with a smaller id.

    Returns all columns but `text_col`, and `kept` (binary), `n_bytes` and `spans` (removed runs as byte offsets), which replace columns of
    these names. With `whole_characters` a UTF-8 character stays unless all its bytes go, so `kept` is text again. Texts are judged as they
    came in, overlaps count, and matches never cross documents. Texts that are null, empty or shorter than `length` stay (null as empty
    bytes); rows with a null id take no part and stay; rows with equal ids never remove from each other. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = SubstringDedup(length, token, tasks, whole_characters)
    text = F.col(text_col).cast("binary")
    others = T.StructType([f for f in docs.schema if f.name not in (id_col, text_col, "kept", "n_bytes", "spans")])
    kind = nullable(others)
    rest = [F.struct(*(F.col(f"`{f.name}`") for f in others)).cast(kind).alias("rest")] if len(others) else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), text.alias("text"), *rest)
    bare = rows.select("id", "tag", "text")

    counted = bare.mapInArrow(returned(steps.tokens), "target int, hashes binary, docs binary").repartitionById(tasks, "target").mapInArrow(returned(steps.shared_tokens), steps.BLOB)
    gathered = bare.mapInArrow(returned(steps.compressed), steps.BLOB).unionByName(counted).repartitionById(tasks, "target").sortWithinPartitions("kind")
    found = gathered.mapInArrow(returned(steps.suffixes(_splitters(bare, steps, tasks))), "target int, kind int, data binary")
    marks = found.repartitionById(tasks, "target").mapInArrow(returned(steps.buckets), steps.BLOB)
    blob, kept = (T.StructType.fromDDL(x) for x in (steps.BLOB, steps.KEPT))
    if rest:
        blob, kept = blob.add("rest", kind), kept.add("rest", kind)
    final = rows.mapInArrow(returned(steps.compressed), blob).unionByName(marks, allowMissingColumns=True).repartitionById(tasks, "target").sortWithinPartitions("kind")
    out = final.mapInArrow(returned(steps.cut), kept)
    return out.select(F.col("id").alias(id_col), *(F.col(f"rest.`{f.name}`").alias(f.name) for f in others), "kept", "n_bytes", "spans")


def _splitters(rows: DataFrame, steps: SubstringDedup, tasks: int) -> np.ndarray:
    """Leading tokens that cut a bounded sample of anchors into equal parts."""
    n = rows.count()
    width, before = steps.anchors.token, steps.before

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _documents(batches):
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            position = steps.anchors.of(data, ends)[0][::16]
            around = _surroundings(data, position, np.full(len(position), before), np.full(len(position), steps.length), before, steps.length)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in around[:, before : before + width]], pa.binary())], names=["lead"])

    some = rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed=1)
    leads_of = some.mapInArrow(returned(leads), "lead binary").orderBy(F.xxhash64("lead", F.monotonically_increasing_id())).limit(100 * tasks)
    found = np.sort(np.array([bytes(r[0]) for r in leads_of.collect()], dtype=f"S{width}"))
    return np.unique(found[np.linspace(0, len(found) - 1, tasks + 1).astype(int)[1:-1]]) if len(found) else found
