"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints that differ in at most d bits differ in at most d bytes. Of the 8 bytes of a 64-bit fingerprint they share at least 8 - d
positional bytes (5 for d = 3). Postings of one byte each would grow with the square of the corpus, so a posting's key holds `KEY_BYTES`
positions at once, taken from a set of position tuples of which every possible set of shared positions contains one: no pair is
missed. Pairs that meet have their shared positional bytes tallied, those below the guaranteed count go, the rest is verified by the bits.

Looser similarity needs longer fingerprints: `lanes` of 64 bits, of which d leaves no byte guaranteed. There the keys are `SAMPLED` fixed choices of
`KEY_BITS` bits, few enough that pairs at 0.8 of the shingles nearly all meet (tests measure it). So short keys bring strangers together; a
posting carries the first 128 bits, and only entries with a near one beside them go on to whole fingerprints. With `similarity`, links
are those pairs whose sets of shingles have that Jaccard likeness, compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.graph import connected_components
from pairlens.llm.workers import returned, small_batches
from pairlens.session import checkpointed, written

KEY_BYTES = 4
#: Keys of several lanes, and the bits that each holds.
SAMPLED, KEY_BITS = 128, 16
#: Standard deviations by which the first 128 bits may exceed their share of the distance.
SLACK = 3.5
#: Fingerprints of one posting that a task compares at once; larger postings are split into pairs of such blocks.
BLOCK = 8192
#: Pairs of 128 bits that are compared at once.
PAIRS = 1 << 18
#: Links that go out at once.
LINKS = 1 << 16
_NO_LINKS = np.zeros((0, 2), np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def position_tuples(positions: int, shared: int) -> list[tuple[int, ...]]:
    """Tuples of `KEY_BYTES` byte positions such that every set of `shared` positions contains one (greedy cover of 8 positions).

    Without that guarantee (fewer shared than a key holds, or more positions) a fixed sample of tuples.
    """
    if positions == 8 and shared >= KEY_BYTES:
        missing, chosen = set(combinations(range(8), shared)), []
        while missing:
            best = max(combinations(range(8), KEY_BYTES), key=lambda t: sum(set(t) <= set(m) for m in missing))
            chosen.append(best)
            missing = {m for m in missing if not set(best) <= set(m)}
        return chosen
    rng, found = np.random.default_rng(11), set()
    while len(found) < min(SAMPLED, math.comb(positions, KEY_BYTES)):
        found.add(tuple(sorted(rng.choice(positions, KEY_BYTES, replace=False).tolist())))
    return sorted(found)


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes and their remixes, a column each."""
    out = [hashes]
    for k in range(1, lanes):
        x = (hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(32)))
    return np.stack(out, axis=1)


def shingle_hashes(text: bytes | None, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of one UTF-8 text in order: A-Z lower-cased, ASCII white space splits; a shorter text is one shingle."""
    parts = (text or b"").lower().split()
    if not parts:
        return []
    n = len(parts)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n < words:
        return [digest(joined, seed)]
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1, out=at[1:])
    return [digest(joined[s:e], seed) for s, e in zip(at[: n - words + 1].tolist(), (at[words:] - 1).tolist())]


def text_fingerprint(text: bytes | None, words: int, seed: int, lanes: int = 1, distinct: bool = False) -> list[int]:
    """Fingerprint of one UTF-8 text: majority of the shingles' XXH64 bits, each shingle counted as often as it occurs or once (`distinct`)."""
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return [0] * lanes
    if distinct:
        hashes = list(set(hashes))
    size = 8 * lanes
    octets = np.ascontiguousarray(_lanes(np.array(hashes, dtype="<u8"), lanes)).view(np.uint8).reshape(-1, size)
    counts = np.bincount((octets + np.arange(0, 256 * size, 256)).ravel(), minlength=256 * size).reshape(size, 256) @ _BITS
    return np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<i8").tolist()


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, lanes: int = 1, distinct: bool = False
) -> DataFrame:
    """`id_col` and `fp` (bigint array, 64 bits per lane) per row, from whole texts. A null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([text_fingerprint(t.as_py(), words, seed, lanes, distinct) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(returned(run), f"id {kind}, fp array<bigint>").withColumnRenamed("id", id_col)


def _key(positions: tuple[int, ...], lanes: int) -> Column:
    """One number for the bytes at these positions; other bytes with the same number are told apart when pairs are verified."""
    masks = np.array([255 if i in positions else 0 for i in range(8 * lanes)], np.uint8).view("<i8").tolist()
    parts = [F.get("fp", F.lit(k)).bitwiseAND(F.lit(m)) for k, m in enumerate(masks) if m]
    return parts[0] if lanes == 1 else F.xxhash64(*parts)


def sampled_keys(values: np.ndarray) -> np.ndarray:
    """`SAMPLED` keys for each fingerprint (rows of lanes): `KEY_BITS` of its bits, below the number of the choice."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    rng = np.random.default_rng(11)
    out = np.empty((len(values), SAMPLED), np.int32)
    for k in range(SAMPLED):
        own = bits[:, rng.choice(bits.shape[1], KEY_BITS, replace=False)].astype(np.int32)
        out[:, k] = (own << np.arange(KEY_BITS, dtype=np.int32)).sum(axis=1, dtype=np.int32) | (k << KEY_BITS)
    return out


def head_distance(distance: int, lanes: int) -> int:
    """What the first 128 bits of fingerprints within `distance` differ in at most: their share and `SLACK` deviations more."""
    bits, head = 64 * lanes, min(128, 64 * lanes)
    share = min(distance / bits, 1.0)
    return min(distance, math.ceil(head * share + SLACK * math.sqrt(head * share * (1 - share) * (bits - head) / max(bits - 1, 1))))


def _near_postings(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted postings, the entries whose first 128 bits lie within `bound` of another's, once each, with their number.

    A posting of over `BLOCK` entries keeps all. Holds a batch and the posting that it breaks off in.
    """

    def beside(x: np.ndarray) -> np.ndarray:
        """Which rows of equally large postings (postings, entries, 2) have a near one beside them."""
        n = x.shape[1]
        out = np.zeros(x.shape[:2], bool)
        step = max(1, PAIRS // (n * n))
        for s in range(0, len(x), step):
            part = x[s : s + step]
            for lo in range(0, n, max(1, PAIRS // n)):
                rows = part[:, lo : lo + max(1, PAIRS // n)]
                apart = np.bitwise_count(rows[:, :, None, :] ^ part[:, None, :, :]).sum(axis=3, dtype=np.uint8)
                near = apart <= bound
                at = np.arange(rows.shape[1])
                near[:, at, lo + at] = False
                out[s : s + step, lo : lo + rows.shape[1]] = near.any(axis=2)
        return out

    def several(part: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        keep = np.zeros(len(part), bool)
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(part)))
        for n in np.unique(size[size > 1]).tolist():
            rows = new[size == n][:, None] + np.arange(n)
            keep[rows] = True if n > BLOCK else beside(head[rows])
        part, head = part[keep], head[keep]
        order = np.lexsort((head[:, 1], head[:, 0], part))
        part, head = part[order], head[order]
        if len(part):
            fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (head[1:] != head[:-1]).any(axis=1)])
            part, head = part[fresh], head[fresh]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(part)))
        columns = (part, head[:, 0].view(np.int64), head[:, 1].view(np.int64), np.repeat(size, size).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "h0", "h1", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            head = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], axis=1)
            if ended := _ending((batch.column("part").to_numpy(), head), going):
                yield several(*ended)
        if going:
            yield several(*map(np.concatenate, zip(*going)))

    return run


def _wide_groups(distinct: DataFrame, distance: int, lanes: int) -> DataFrame:
    """`fps`: the fingerprints of several lanes (with what else `distinct` has, as a structure) that share a posting, or a pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(s, 4096).flatten().to_numpy().reshape(-1, lanes)
                keys = sampled_keys(values)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, SAMPLED, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in (0, min(1, lanes - 1))] + [lists], names=["h0", "h1", "parts"])

    heads = [F.get("fp", F.lit(0)).alias("h0"), F.get("fp", F.lit(min(1, lanes - 1))).alias("h1")]
    rows = distinct.select("fp").mapInArrow(returned(run), "h0 bigint, h1 bigint, parts array<int>").select("h0", "h1", F.explode("parts").alias("part"))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(returned(_near_postings(head_distance(distance, lanes))), "part int, h0 bigint, h1 bigint, n bigint")
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("h0", "h1"), blocks)
    met = met.select("part", "h0", "h1", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
    met = met.join(distinct.select(*heads, F.struct("fp", *[c for c in distinct.columns if c != "fp"]).alias("entry")), ["h0", "h1"])
    return met.groupBy("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.sort_array(F.collect_list("entry")).alias("fps"))


def _ending(columns: tuple[np.ndarray, ...], open_: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
    """Of sorted rows, keyed by the first column, those whose posting ends in this batch, with what `open_` holds of the first one.

    The posting that may go on stays in `open_` in pieces, so that a long one is copied once. None if no posting ends.
    """
    part = columns[0]
    if not len(part):
        return None
    if open_ and open_[0][0][0] == part[0] == part[-1]:
        open_.append(columns)
        return None
    cut = np.searchsorted(part, part[-1])
    ended = [*open_, tuple(c[:cut] for c in columns)]
    open_[:] = [tuple(c[cut:].copy() for c in columns)]
    return tuple(map(np.concatenate, zip(*ended)))


def _link_batch(values: np.ndarray, links: list[np.ndarray]) -> pa.RecordBatch:
    """Links, given as pairs of row numbers of `values` (fingerprints), as `a` and `b`."""
    rows = np.concatenate(links)
    at = pa.array(np.arange(0, (len(rows) + 1) * values.shape[1], values.shape[1], dtype=np.int32))
    ends = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(values[rows[:, k]]).view(np.int64).ravel())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _spanning_links(values: np.ndarray, distance: int, shared: int) -> np.ndarray:
    """Links (pairs of row numbers) that connect whatever is connected inside one block: each row is compared once with those not yet reached."""
    links, rest = [_NO_LINKS], np.arange(len(values))
    octets, numbers = values.view(np.uint8).reshape(len(values), -1), values.view(np.uint64)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = (octets[rest] == octets[node]).sum(axis=1) >= shared
            near[near] = np.bitwise_count(numbers[rest[near]] ^ numbers[node]).sum(axis=1, dtype=np.int64) <= distance
            if near.any():
                found = rest[near]
                links.append(np.stack([np.full(len(found), node), found], axis=1))
                queue += found.tolist()
                rest = rest[~near]
    return np.concatenate(links)


def _shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings, those of several entries, with their number. Holds a batch and the posting that it breaks off in."""
    going: list[tuple[np.ndarray, ...]] = []

    def several(part: np.ndarray, fid: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(part)))
        n = np.repeat(size, size)
        return pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (part, fid, n)], names=["part", "fid", "n"])

    for batch in batches:
        if ended := _ending((batch.column("part").to_numpy(), batch.column("fid").to_numpy()), going):
            yield several(*ended)
    if going:
        yield several(*map(np.concatenate, zip(*going)))


def near_links(distinct: DataFrame, distance: int = 3, lanes: int = 1) -> DataFrame:
    """`a`, `b`: links between distinct fingerprints (column `fp`) that connect all that lie within `distance` bits and meet in a posting.

    Not every close pair is listed: inside a posting a spanning forest is, so a group of n near copies gives at most
    n - 1 links per posting. A posting of over `BLOCK` fingerprints is split into pairs of blocks.
    """
    spark = distinct.sparkSession
    shared = max(8 * lanes - distance, KEY_BYTES) if lanes == 1 else 0
    if lanes == 1:
        # Postings hold the fingerprint as a number, which is exchanged for it once few are left.
        own_id = F.get("fp", F.lit(0))
        posts = F.array(*[F.xxhash64(F.lit(i), _key(t, lanes)) for i, t in enumerate(position_tuples(8 * lanes, 8 * lanes - distance))])
        rows = distinct.select(own_id.alias("fid"), F.explode(posts).alias("part"))
        blocks = F.ceil(F.col("n") / BLOCK)
        own = F.pmod(F.xxhash64("fid"), blocks)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(returned(_shared_postings), "part bigint, fid bigint, n bigint")
        met = met.select("part", "fid", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
        met = met.join(distinct.select(own_id.alias("fid"), "fp"), "fid")
        groups = met.groupBy("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    else:
        groups = _wide_groups(distinct.select("fp"), distance, lanes).select(F.col("fps.fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, at = lists.flatten().flatten().to_numpy().reshape(-1, lanes), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(at)
            two = at[:-1][sizes == 2]
            near = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= distance
            links, n = [np.stack([two[near], two[near] + 1], axis=1)], 0
            for s, e in zip(at[:-1][sizes > 2].tolist(), at[1:][sizes > 2].tolist()):
                links.append(_spanning_links(np.ascontiguousarray(values[s:e]), distance, shared) + s)
                n += len(links[-1])
                if n > LINKS:
                    yield _link_batch(values, links)
                    links, n = [_NO_LINKS], 0
            yield _link_batch(values, links)

    return groups.select("fps").mapInArrow(returned(run), "a array<bigint>, b array<bigint>").distinct()


def cross_links(distinct: DataFrame, distance: int, lanes: int) -> DataFrame:
    """`a`, `b`: all pairs of fingerprints (column `fp`) within `distance` bits that meet in a posting and differ in `root`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                values, root = (row.values.field(c).flatten().to_numpy().reshape(-1, lanes) for c in ("fp", "root"))
                numbers = values.view(np.uint64)
                roots = np.unique(root, axis=0, return_inverse=True)[1].ravel()
                links, n = [_NO_LINKS], 0
                for k in range(len(values) - 1):
                    rest = np.flatnonzero(roots[k + 1 :] != roots[k]) + k + 1
                    rest = rest[np.bitwise_count(numbers[rest] ^ numbers[k]).sum(axis=1, dtype=np.int64) <= distance]
                    links.append(np.stack([np.full(len(rest), k), rest], axis=1))
                    n += len(rest)
                    if n > LINKS:
                        yield _link_batch(values, links)
                        links, n = [_NO_LINKS], 0
                if n:
                    yield _link_batch(values, links)

    return _wide_groups(distinct.select("fp", "root"), distance, lanes).select("fps").mapInArrow(returned(run), "a array<bigint>, b array<bigint>").distinct()


def alike(links: DataFrame, texts: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """The links whose texts have at least this Jaccard likeness of their distinct shingles.

    texts: `fp` and `text` (binary), one row for each end of the links at least.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), words, seed), np.uint64)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / max(len(x) + len(y) - both, 1) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = texts.select("fp", "text").mapInArrow(returned(shingles), "fp array<bigint>, own array<bigint>")
    pairs = links.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(returned(compare), "a array<bigint>, b array<bigint>")


def _alike_roots(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, seed: int, lanes: int, similarity: float) -> DataFrame:
    """`node`, `root` over links within `distance` bits that the whole sets of shingles confirm.

    A posting lists a spanning forest, of which a refused link may have hidden others: where a component falls apart,
    all pairs between its parts are listed and compared too.
    """
    # One text stands for a fingerprint: sets that agree in all bits of several lanes differ by a negligible share. Joined by id and hash, so copies do not gather.
    key = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("hash")]

    def texts_of(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp"))).distinct()
        wanted = classes.select("fp", "least", "hash").join(ends, "fp", "left_semi")
        rows = docs.select(*key, F.col(text_col).cast("binary").alias("text")).alias("d")
        on = F.col("d.id").eqNullSafe(F.col("w.least")) & (F.col("d.hash") == F.col("w.hash"))
        return written(rows.join(wanted.alias("w"), on).select("fp", "text").dropDuplicates(["fp"]), "near-texts")

    links = checkpointed(near_links(classes.select("fp"), distance, lanes))
    good = checkpointed(alike(links, texts_of(links), words, seed, similarity))
    loose, roots = connected_components(links), connected_components(good)
    named = loose.select(F.col("node").alias("fp"), F.col("root").alias("all")).union(loose.select("root", "root").distinct())
    parts = checkpointed(named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "all", F.coalesce("root", "fp").alias("root")))
    apart = parts.groupBy("all").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("all")
    again = checkpointed(parts.join(apart, "all", "left_semi").select("fp", "root"))
    more = checkpointed(cross_links(again, distance, lanes).join(links, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return roots
    return connected_components(good.union(alike(more, texts_of(more), words, seed, similarity)))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42, lanes: int = 1, similarity: float | None = None
) -> DataFrame:
    """`id_col`, `fp` and `component_id` (smallest id reachable over links of at most `distance` bits) per row.

    With `similarity` (several lanes), fingerprints are those of the distinct shingles, and a link holds only if the sets of shingles have this Jaccard
    likeness at least. Copies share a fingerprint and so a component; a null or empty text has fingerprint zero, linked like any other.
    Rows with equal ids stay separate rows. A null id keeps its row and never names a component (null only if its whole
    component has no id). An empty table gives an empty result; other columns are not read.
    """
    if similarity is None:
        rows = written(fingerprints(docs, id_col, text_col, words, seed, lanes), "fingerprints")
        classes = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
        roots = connected_components(near_links(classes.select("fp"), distance, lanes))
    else:
        if lanes == 1:
            raise ValueError("a similarity needs fingerprints of several lanes")
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("hash")).alias("key"), text_col)
        rows = written(fingerprints(keyed, "key", text_col, words, seed, lanes, True).select(F.col("key.id").alias(id_col), F.col("key.hash").alias("hash"), "fp"), "fingerprints")
        first = F.coalesce(F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), "hash"))), F.min(F.struct(F.col(id_col).alias("id"), "hash")))
        classes = checkpointed(rows.groupBy("fp").agg(first.alias("first")).select("fp", F.col("first.id").alias("least"), F.col("first.hash").alias("hash")))
        roots = _alike_roots(classes, docs, id_col, text_col, words, distance, seed, lanes, similarity)
    roots = roots.withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, "fp", "component_id")
