"""SentencePiece encoding by streaming Viterbi, and decoding.

A text's segmentation is the one whose pieces' scores have the largest sum (of equals, the one whose last pieces are longest); what no piece
covers goes by the bytes' own pieces. The encoder keeps the best sums and backpointers of the last `longest` characters only: a
piece is no longer than that. Once the backpointer paths of all survivors meet in one boundary, nothing can change before it, and the ids up to it are committed.
In prose that happens every few characters, and at the latest, as a rule, before the mark of white space (U+2581) that a word ends with; what the stream committed for
such a word is remembered.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose ids a worker remembers in a generation. Characters pushed at once.
MAX_WORDS, PUSH = 350_000, 4096
_LEAST = float("-inf")


class Vocabulary:
    """Pieces with scores, and the prefixes that tell when no longer piece can match."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_of: dict[int, int]) -> None:
        """pieces: (piece, score) by id; those of control or byte ids are left out of matching. bytes_of: id by byte value."""
        self.bytes_of = bytes_of
        skip = set(bytes_of.values())
        #: Score and id by piece; None for a mere prefix.
        self.match: dict[str, tuple[float, int] | None] = {}
        for k, (piece, score) in enumerate(pieces):
            if k in skip or not piece or piece.startswith("<") and piece.endswith(">") and score == 0 and len(piece) > 2:
                continue
            for n in range(1, len(piece)):
                self.match.setdefault(piece[:n], None)
            self.match[piece] = (score, k)
        self.longest = max((len(p) for p, m in self.match.items() if m), default=1)
        self.byte_score = min((m[0] for m in self.match.values() if m), default=0.0) - 10.0
        #: Whether a mark of white space can only begin a piece (after others of its kind).
        self.splits = not any(m and SPACE in p.lstrip(SPACE) for p, m in self.match.items())
        #: The same as steps from character to character: (next steps, score, id); a mere prefix has the least score.
        self.roots: dict[str, tuple[dict, float, int]] = {}
        steps: dict[str, dict] = {"": self.roots}
        for piece in sorted(self.match, key=len):
            found = self.match[piece]
            steps[piece] = kids = {}
            steps[piece[:-1]][piece[-1]] = (kids, *(found or (_LEAST, -1)))

        #: Characters that are never better off by their bytes.
        self.covered = {c for c, (_, score, _) in self.roots.items() if score > _LEAST and self.byte_score <= 0}

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode()]


class StreamingViterbi:
    """Feed characters, get ids as soon as they are certain. Holds a window, never the text.

    Every boundary starts a walk over the characters that follow, for as long as they begin a piece. Survivors at a boundary are itself and the earlier ones
    whose walks lead beyond it; every later path comes from one of them. Where no walk does, all paths meet there, and the stream commits at once; otherwise
    the survivors' paths are followed back when the window is full.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.commits = 0  # how often surviving paths met
        self.reset()

    def reset(self) -> None:
        self.chars = ""  # the window's characters
        self.best: list[float] = [0.0]  # best sum up to each boundary in the window
        self.back: list[int] = [0]  # boundary before the last piece
        self.piece: list[int] = [-1]  # its id, -1 for bytes
        self.ends: list[int] = []  # where each boundary's walk stopped
        self.open: list[tuple[int, dict]] = []  # walks that the next character may go on: start and steps

    def feed(self, chars: str) -> Iterator[list[int]]:
        """Ids that become certain with these characters, piece by piece."""
        for at in range(0, len(chars), PUSH):
            yield self.push(chars[at : at + PUSH])

    def push(self, chars: str, ahead: bool = False) -> list[int]:
        """Ids that become certain with these characters.

        ahead: the last one is only looked at. If the paths meet before it, `met` is set and the stream is clean without it; else it counts like the others.
        """
        self.met = False
        vocabulary = self.vocabulary
        roots, covered, byte_score, longest = vocabulary.roots, vocabulary.covered, vocabulary.byte_score, vocabulary.longest
        window = 4 * longest
        text = self.chars + chars
        first, n = len(self.chars), len(text)
        best, back, piece, ends = self.best, self.back, self.piece, self.ends
        best += [_LEAST] * len(chars)
        back += [0] * len(chars)
        piece += [-1] * len(chars)
        out: list[int] = []
        going: list[tuple[int, dict]] = []
        done, far = 0, first  # committed up to `done`; no walk leads beyond `far`
        for i, steps in self.open:
            far = max(far, self._walk(i, first, steps, text, going))
        for i in range(first, n):
            if i > done and (far <= i or i - done >= window):
                upto = i if far <= i else self._meeting(i)
                if upto > done:
                    self.commits += 1
                    self._path(text, done, upto, out)
                    done = upto
                    if ahead and done == n - 1:
                        self.reset()
                        self.met = True
                        return out
            base, steps, j = best[i], roots, i
            for char in text[i : i + longest]:
                node = steps.get(char)
                if node is None:
                    break
                j += 1
                steps, score, k = node
                # Starts come in ascending order: of equal sums the first, longest piece stays.
                if base + score > best[j]:
                    best[j], back[j], piece[j] = base + score, i, k
            else:
                if steps and j == n:
                    going.append((i, steps))
                    j = n + 1
            if j > far:
                far = j
            ends.append(j)
            if text[i] not in covered:
                value = base + byte_score * len(text[i].encode())
                if value > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = value, i, -1
        if far <= n and n > done:
            self.commits += 1
            self._path(text, done, n, out)
            done = n
        if done:
            shift = best[done]
            self.best = [v - shift for v in best[done:]]
            self.back = [0, *[v - done for v in back[done + 1 :]]]
            self.piece = [-1, *piece[done + 1 :]]
            self.ends = [v - done for v in ends[done:]]
            going = [(i - done, steps) for i, steps in going]
        self.chars, self.open = text[done:], going
        return out

    def _walk(self, i: int, j: int, steps: dict, text: str, going: list[tuple[int, dict]]) -> int:
        """Goes on with the walk from boundary `i` at character `j`; returns where it stops."""
        best, n = self.best, len(text)
        while j < n:
            node = steps.get(text[j])
            if node is None:
                break
            j += 1
            steps, score, k = node
            if best[i] + score > best[j]:
                best[j], self.back[j], self.piece[j] = best[i] + score, i, k
        else:
            if steps:
                going.append((i, steps))
                j = n + 1
        self.ends[i] = j
        return j

    def finish(self) -> list[int]:
        """The rest; the text ends here."""
        ids: list[int] = []
        self._path(self.chars, 0, len(self.chars), ids)
        self.reset()
        return ids

    def _meeting(self, n: int) -> int:
        """The last boundary that lies on the path of every survivor at boundary `n`."""
        alive = {n, *(start for start, end in enumerate(self.ends) if end > n)}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return alive.pop()

    def _path(self, text: str, done: int, upto: int, out: list[int]) -> None:
        """Appends the ids of the best path from boundary `done` to `upto`."""
        back, piece, ids = self.back, self.piece, []
        while upto > done:
            before, name = back[upto], piece[upto]
            if name < 0:
                ids += reversed(self.vocabulary.byte_ids(text[before]))
            else:
                ids.append(name)
            upto = before
        ids.reverse()
        out += ids


def encode_whole(vocabulary: Vocabulary, text: str) -> list[int]:
    """The same by a table over the whole text, walking the prefixes forward; what the stream is tested against."""
    n, match = len(text), vocabulary.match
    best, back = [-np.inf] * (n + 1), [(0, None)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        base = best[i]
        own = base + vocabulary.byte_score * len(text[i].encode())
        if own > best[i + 1]:
            best[i + 1], back[i + 1] = own, (i, None)
        for j in range(i + 1, min(n, i + vocabulary.longest) + 1):
            found = match.get(text[i:j], 0)
            if found == 0:
                break
            # Starts come in ascending order: of equal sums the first, longest piece stays.
            if found and (base + found[0] > best[j] or base + found[0] == best[j] and back[j][1] is None):
                best[j], back[j] = base + found[0], (i, found[1])
    ids: list[int] = []
    while n:
        before, piece = back[n]
        ids += reversed(vocabulary.byte_ids(text[before])) if piece is None else [piece]
        n = before
    return ids[::-1]


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder(dict):
    """Whole texts through `encode`; remembers packed ids of words, in two generations of which the older goes when the newer is full.

    A word is remembered only where the stream, clean before it, committed exactly the word on seeing the mark of white space after it: then whatever follows, the paths
    meet there again. Where they do not, the stream runs on over the text until it is clean at the end of a word.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.stream = StreamingViterbi(vocabulary)
        self.older: dict[str, bytes] = {}
        self.mark = b"".join(np.array(k, "<u4").tobytes() for k in vocabulary.byte_ids(SPACE))

    def _run(self, words: list[str], at: int, out: list[bytes]) -> int:
        """Streams from word `at`, the stream being clean, to the first end of a word where all paths meet; appends ids, returns the next word."""
        stream, ids, first = self.stream, [], at
        while at < len(words):
            word = words[at]
            at += 1
            if at == len(words) or not words[at].startswith(SPACE):
                ids += chain.from_iterable(stream.feed(word))
                continue
            # With a look at the mark after it: if the paths meet before that, the next word starts afresh from it.
            if len(word) >= PUSH:
                ids += chain.from_iterable(stream.feed(word))
                word = ""
            ids += stream.push(word + SPACE, True)
            if stream.met:
                packed = array("I", ids).tobytes()
                if at == first + 1 and 0 < len(word) <= 64:
                    self[word] = packed
                out.append(packed)
                return at
            words[at] = words[at][1:]
            if not words[at]:
                at += 1
        ids += stream.finish()
        out.append(array("I", ids).tobytes())
        return at

    def _plain(self, text: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.older = dict(self)
            self.clear()
        words = _WORD.findall(text)
        known = list(map(self.get, words))
        if None not in known:
            return b"".join(known)
        out: list[bytes] = []
        at = 0
        while at < len(words):
            try:
                unseen = known.index(None, at)
            except ValueError:
                out += known[at:]
                break
            out += known[at:unseen]
            word, at = words[unseen], unseen
            ids = self.get(word)  # met since, in this text
            if ids is None and (ids := self.older.get(word)) is not None:
                self[word] = ids
            if ids is None:
                at = self._run(words, at, out)
            else:
                out.append(ids)
                at += 1
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as packed uint32. A text starts with a mark of white space, spaces become marks; a mark of the text's own goes by its bytes."""
        if not text:
            return b""
        return self.mark.join(self._plain(part.replace(" ", SPACE)) if part else b"" for part in (" " + text).split(SPACE))


def _kept() -> dict:
    """What a worker process keeps between tasks. Functions reach workers by value, with globals that last for a task; a module of the process lasts."""
    return sys.modules.setdefault("_pairlens_encoders", ModuleType("_pairlens_encoders")).__dict__


def _pieces(path: str) -> tuple[list[tuple[str, float]], dict[int, int]]:
    """Pieces with scores by id, and ids by byte value, of a SentencePiece model."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
    return pieces, {int(p[3:5], 16): k for k, (p, _) in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, with the words it remembers."""
    kept = _kept()
    if path not in kept:
        kept[path] = Encoder(Vocabulary(*_pieces(path)))
    return kept[path]


def texts_of(pieces: list[tuple[str, float]], bytes_of: dict[int, int]) -> list[bytes]:
    """The bytes that each id stands for, marks of white space as spaces."""
    out = [p.replace(SPACE, " ").encode() for p, _ in pieces]
    for value, k in bytes_of.items():
        out[k] = bytes([value])
    return out


def decoded(table: list[bytes], ids: np.ndarray) -> str:
    """The text of some ids, without the mark that it started with."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and `ids` (int array, replaces a column of that name) of the whole text.

    A null text has null ids, an empty one none; repeated rows stay; an empty table gives an empty result.
    """
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                chunk = batch.slice(part, 512)
                ids = [None if (t := x.as_py()) is None else np.frombuffer(own.encode(t), "<i4") for x in chunk.column(text_col)]
                yield chunk.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns and `decoded` (replaces a column of that name): the text that the ids stand for. Null ids give a null text."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = texts_of(*_pieces(model))
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                chunk = batch.slice(part, 512)
                texts = [None if not x.is_valid else decoded(table, x.values.to_numpy(zero_copy_only=False)) for x in chunk.column(ids_col)]
                yield chunk.append_column("decoded", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
