"""Problem 4: records whose sets of word shingles are similar, exactly.

A set-similarity join with prefix filter, carried out with two kinds of skipping. Index lists (the records that have a rare
shingle) are ordered by size class and position and kept in blocks: a block is met only by blocks whose sizes and positions can
still reach the threshold. And answers are derived from those of similar sets: sets with equal content are one class, whose
links are found once; a set is compared with one similar set, its pivot, and what it shares with the pivot's other partners
is then bounded by the two distances to the pivot, which settles most pairs without looking at their sets."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Splitter, bitmap, cut, in_bitmap, mix, one_per_key

#: Slots of the table of frequencies: about half as many as there are shingles, within these bounds (a task counts in four bytes a slot).
LEAST_SLOTS, MOST_SLOTS, SLOT_BLOCK = 1 << 23, 1 << 25, 1 << 17
BLOCK = 64
#: A list longer than this is met in pieces, pair by pair of pieces.
HOT = 20_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LOW40 = np.uint64((1 << 40) - 1)


def shingle_sets(texts: list, split: Splitter, width: int, least_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number (row) and hash, once per distinct shingle of `width` terms, ordered by both, for texts of at
    least `least_terms` terms."""
    flat, n = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        h = split.hashes(t)
        if len(h) >= max(least_terms, width):
            flat += h
            n[i] = len(h)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.array(flat, np.uint64)
    made = h[: len(h) - width + 1] * _ODD[0]
    for k in range(1, width):
        made = mix(made + h[k : len(h) - width + 1 + k] * _ODD[1]) * _ODD[2]
    row = np.repeat(np.arange(len(texts)), n)
    inside = row[: len(made)] == row[width - 1 :]
    row, made = row[: len(made)][inside], mix(made[inside])
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    return row[first], made[first]


def _pack(x: np.ndarray) -> bytes:
    """The low 40 bits of each hash."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def record_sets(records: DataFrame, width: int, least_terms: int) -> DataFrame:
    """key, fp (fingerprint of the set of full hashes), n (its size), shingles (40 bits of each hash) for the texts that
    have a set, from a frame (key, text). In a pair of sets of some hundred shingles, 40 bits mistake one shingle with a
    chance below one in a million."""
    kind = records.schema[0].dataType.simpleString()

    def run(batches):
        split = Splitter()
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            row, made = shingle_sets(texts, split, width, least_terms)
            ends = np.cumsum(np.bincount(row, minlength=len(texts)))
            starts = np.concatenate([[0], ends[:-1]])
            use = np.nonzero(ends > starts)[0]
            sums = np.add.reduceat(mix(made ^ _ODD[2]), starts[use]) if len(use) else np.zeros(0, np.uint64)
            n = (ends - starts)[use]
            fp = mix(sums ^ n.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(use)), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int32)), pa.array([_pack(made[starts[i] : ends[i]]) for i in use], pa.binary())], ["key", "fp", "n", "shingles"]
            )

    return records.mapInArrow(run, f"key {kind}, fp long, n int, shingles binary")


def _flat(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch, and how many each set has."""
    parts = batch.column(column).to_pylist()
    return _unpack(b"".join(parts)), np.array([len(x) // 5 for x in parts], np.int64)


def _slot(made: np.ndarray, slots: int) -> np.ndarray:
    return (made & np.uint64(slots - 1)).astype(np.int64)


def document_frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, by slots of its hash, in eighths of a power of two (0: none, 1: one): a table of bounded size (at
    most 32 MB) over all sets. It only orders shingles and tells where hot ones may be; slots that are shared cost selectivity, never a pair."""
    entries = sets.agg(F.sum("n")).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << int(np.ceil(np.log2(max(2, entries) / 2)))))

    def count(batches):
        total = np.zeros(slots, np.uint32)
        for b in batches:
            made, _ = _flat(b, 0)
            at, n = np.unique(_slot(made, slots), return_counts=True)
            total[at] += n.astype(np.uint32)
        total = total.reshape(-1, SLOT_BLOCK)
        use = np.nonzero(total.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([zlib.compress(total[i].tobytes(), 1) for i in use], pa.binary())], ["block", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(*(x.to_pylist() for x in b.columns)):
                x = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
                total[k] = total[k] + x if k in total else x
        coded = [zlib.compress(np.where(x > 0, 1 + np.round(8 * np.log2(np.maximum(x, 1))), 0).astype(np.uint8).tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(coded, pa.binary())], ["block", "counts"])

    table = np.zeros((slots // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for r in sets.select("shingles").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(merge, "block int, counts binary").collect():  # at most a byte a slot
        table[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return table.ravel()


def hot_shingles(sets: DataFrame, table: np.ndarray, frequencies) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in more than HOT sets, sorted, and in how many: those of the slots that count more are counted one by
    one, each task's first. There are at most as many as all shingles together divided by HOT."""
    least = 1 + 8 * np.log2(HOT)
    if not (table >= least - 1).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(batches):
        coded, held = frequencies.value, []
        rows = 0

        def flush():
            made, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

        for b in batches:
            made, _ = _flat(b, 0)
            held.append(made[coded[_slot(made, len(coded))] >= least - 1])
            rows += len(held[-1])
            if rows > 2_000_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    found = sets.select("shingles").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).orderBy("shingle").collect()
    made, n = np.array([r["shingle"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    return made, n


def needed(threshold: float, a, b):
    """Least overlap of sets of sizes a and b whose Jaccard similarity is at least the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def index_lists(sets: DataFrame, frequencies, hot, threshold: float, extra: int) -> DataFrame:
    """Entries (cell, fp, place) for each set's prefix: its rarest shingles, so many that sets which reach the threshold share
    at least 1 + extra of them; place holds size, position and side. A shingle whose slot counts one set needs no list. A
    shingle that is in more than HOT sets (`hot`: those and their counts) has a cell for each pair of pieces of its list, so that no
    list grows without bound. Sets met before in the task aren't put in again."""

    def run(batches):
        coded, seen, (hot_made, hot_n) = frequencies.value, set(), hot.value
        for b in batches:
            fps = b.column(0).to_numpy()
            new = []
            for i, x in enumerate(fps.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            made, n = _flat(b, 1)
            fps = b.column(0).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            c = coded[_slot(made, len(coded))]
            order = np.lexsort((made, c, row))
            row, made, c = row[order], made[order], c[order]
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 + extra
            keep = (pos < prefix[row]) & (c > 1)
            row, made, c, pos = row[keep], made[keep], c[keep], pos[keep]
            place = (n[row] << 32) | (pos << 1)
            pieces = np.ones(len(made), np.int64)
            if len(hot_made):
                near = np.minimum(np.searchsorted(hot_made, made), len(hot_made) - 1)
                pieces = np.where(hot_made[near] == made, -(-hot_n[near] // HOT), 1)
            cold = pieces <= 1
            parts = [((made[cold] << np.uint64(1)).view(np.int64), fps[row[cold]], place[cold])]
            for g in np.unique(pieces[~cold]):
                at = pieces == g
                mine = (mix(fps[row[at]].view(np.uint64)) % np.uint64(g)).astype(np.int64)
                for other in range(g):
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    cell = mix(made[at] * _ODD[0] + (low * g + high + 1).astype(np.uint64)) | np.uint64(1 << 63)
                    cell = np.where(mine == other, cell & ~np.uint64(1), cell | np.uint64(1))
                    parts.append((cell.view(np.int64), fps[row[at]], place[at] | (mine > other)))
            cols = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["cell", "fp", "place"])

    return sets.select("fp", "shingles").mapInArrow(run, "cell long, fp long, place long")


def _met(cell, fp, place, threshold: float, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints (smaller first, one for each shared cell) of whole lists that pass the size and position tests."""
    n, pos, side = place >> 32, (place & 0xFFFFFFFF) >> 1, place & 1
    group = np.floor(8 * np.log2(n)).astype(np.int64)
    order = np.lexsort((fp, pos, n, group, cell))
    cell, fp, n, pos, side, group = (x[order] for x in (cell, fp, n, pos, side, group))
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])  # copies of a set, met in other tasks
    cell, fp, n, pos, side, group = (x[new] for x in (cell, fp, n, pos, side, group))
    first = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0] if len(cell) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(cell)))
    left = n - pos + extra
    cross = (cell & 1) == 1
    out_a, out_b = [], []

    def test(i, j):
        low, high, need = np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), needed(threshold, n[i], n[j])
        ok = (low >= threshold * high - 1e-9) & (np.minimum(left[i], left[j]) >= need) & (~cross[i] | (side[i] != side[j])) & (fp[i] != fp[j])
        i, j, tiny = i[ok], j[ok], need[ok] <= extra
        if tiny.any():  # sets too small to share more than `extra` entries: one will do
            i, j = (np.concatenate([x, np.repeat(x[tiny], extra)]) for x in (i, j))
        out_a.append(np.minimum(fp[i], fp[j]))
        out_b.append(np.maximum(fp[i], fp[j]))

    short = np.repeat(length <= BLOCK, length)
    i, step = np.nonzero(short)[0], 0
    while len(i):
        step += 1
        i = i[i + step < len(cell)]
        i = i[(cell[i + step] == cell[i]) & (n[i] >= threshold * n[i + step] - 1e-9)]
        test(i, i + step)
    for start, size in zip(first[length > BLOCK], length[length > BLOCK]):
        # within a size class by position, so that a block's entries can share about as much as each other
        at = start + np.lexsort((fp[start : start + size], pos[start : start + size], group[start : start + size]))
        blocks = [at[k : k + BLOCK] for k in range(0, size, BLOCK)]
        least, most = np.array([n[x].min() for x in blocks]), np.array([n[x].max() for x in blocks])
        best = np.array([left[x].max() for x in blocks])
        for k, x in enumerate(blocks):
            others = np.arange(k, len(blocks))
            fits = (threshold * np.maximum(least[k], least[others]) <= np.minimum(most[k], most[others]) + 1e-9) & (np.minimum(best[k], best[others]) >= needed(threshold, least[k], least[others]))
            for o in others[fits]:  # the blocks that aren't skipped
                a, b = np.repeat(x, len(blocks[o])), np.tile(blocks[o], len(x))
                if o == k:
                    a, b = a[(u := np.repeat(np.arange(len(x)), len(x)) < np.tile(np.arange(len(x)), len(x)))], b[u]
                test(a, b)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(a: np.ndarray, b: np.ndarray):
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0] if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.append(first, len(a))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(shared, pa.int32())], ["fp_a", "fp_b", "shared"])


def candidate_links(lists: DataFrame, threshold: float, extra: int) -> DataFrame:
    """Pairs of fingerprints (fp_a < fp_b) that share more than `extra` entries of their prefixes. Lists arrive sorted by
    cell and are met one after the other; a task holds a few lists at a time."""

    def run(batches):
        held: list = []
        rows = 0
        for b in batches:
            held.append([x.to_numpy() for x in b.columns])
            rows += b.num_rows
            if rows < 100_000:
                continue
            cell, fp, place = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(cell, cell[-1], "left"))  # the last list may go on
            if whole:
                yield _counted(*_met(cell[:whole], fp[:whole], place[:whole], threshold, extra))
            held, rows = [[cell[whole:], fp[whole:], place[whole:]]], 0
        if held:
            yield _counted(*_met(*(np.concatenate(x) for x in zip(*held)), threshold, extra))

    pairs = lists.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "fp_a long, fp_b long, shared int")
    return pairs.groupBy("fp_a", "fp_b").agg(F.sum("shared").alias("shared")).filter(F.col("shared") > extra)


def _sets_of(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """fp, n, shingles of the given fingerprints, once each."""
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(fps))

    def run(batches):
        table, seen = bits.value, set()
        for b in batches:
            x = b.column(0).to_numpy()
            some = np.nonzero(in_bitmap(table, x))[0]
            new = []
            for i in some.tolist():
                if (y := int(x[i])) not in seen:
                    seen.add(y)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            yield b.take(pa.array(new, pa.int64()))

    return sets.select("fp", "n", "shingles").mapInArrow(run, "fp long, n int, shingles binary").dropDuplicates(["fp"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """fp_a, fp_b, n_a, n_b, overlap of pairs (fp_a, fp_b), from their sets."""
    a = sets.select(F.col("fp").alias("fp_a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("fp").alias("fp_b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))

    def run(batches):
        for x in batches:
            shared = [len(np.intersect1d(_unpack(p), _unpack(q))) for p, q in zip(x.column(4).to_pylist(), x.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(shared, pa.int32())], ["fp_a", "fp_b", "n_a", "n_b", "overlap"])

    joined = pairs.select("fp_a", "fp_b").join(a, "fp_a").join(b, "fp_b").select("fp_a", "fp_b", "n_a", "n_b", "set_a", "set_b")
    return joined.mapInArrow(run, "fp_a long, fp_b long, n_a int, n_b int, overlap int")


def verified_links(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (fp_a, fp_b) whose similarity reaches the threshold.

    Every set is compared with its pivot, the candidate partner with the least fingerprint. For two sets with one pivot the
    overlap lies between bounds that follow from sizes and distances to the pivot; pairs that the bounds don't settle are
    compared by their sets."""
    both = candidates.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("other")).unionByName(candidates.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("other")))
    pivots = both.groupBy("fp").agg(F.min("other").alias("pivot")).filter("pivot < fp")
    sets = cut(_sets_of(sets, both.select("fp")))
    own = cut(_overlaps(pivots.select(F.col("pivot").alias("fp_a"), F.col("fp").alias("fp_b")), sets))
    least = lambda a, b: F.ceil(threshold / (1 + threshold) * (F.col(a) + F.col(b)) - 1e-9)
    far = own.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("pivot"), F.col("n_b").alias("n"), (F.col("n_a") + F.col("n_b") - 2 * F.col("overlap")).alias("distance"))
    others = candidates.select("fp_a", "fp_b").join(own.select("fp_a", "fp_b"), ["fp_a", "fp_b"], "left_anti")
    side = lambda s: far.select(F.col("fp").alias(f"fp_{s}"), F.col("pivot").alias(f"pivot_{s}"), F.col("n").alias(f"n_{s}"), F.col("distance").alias(f"d_{s}"))
    placed = others.join(side("a"), "fp_a", "left").join(side("b"), "fp_b", "left")
    high = F.floor((F.col("n_a") + F.col("n_b") - F.abs(F.col("d_a") - F.col("d_b"))) / 2)
    low = F.ceil((F.col("n_a") + F.col("n_b") - F.col("d_a") - F.col("d_b")) / 2)
    one = F.coalesce(F.col("pivot_a") == F.col("pivot_b"), F.lit(False))
    judged = cut(placed.select("fp_a", "fp_b", F.when(one & (low >= least("n_a", "n_b")), True).when(one & (high < least("n_a", "n_b")), False).alias("similar")))
    rest = _overlaps(judged.filter("similar is null"), sets)
    reach = lambda df: df.filter(F.col("overlap") >= least("n_a", "n_b")).select("fp_a", "fp_b")
    return reach(own).unionByName(judged.filter("similar").select("fp_a", "fp_b")).unionByName(reach(rest))


def similar_sets(docs: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, least_terms: int = 5, extra: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): key and set fingerprint of every record with at least least_terms terms, and the pairs (fp_a, fp_b)
    of different sets whose Jaccard similarity is at least the threshold, without exception. Null keys and texts, and texts
    with fewer terms than `width`, have no set. A key that occurs with several texts has several sets."""
    spark = docs.sparkSession
    sets = cut(record_sets(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null"), width, least_terms))
    table = document_frequencies(sets)
    frequencies = spark.sparkContext.broadcast(table)
    hot = spark.sparkContext.broadcast(hot_shingles(sets, table, frequencies))
    candidates = cut(candidate_links(index_lists(sets, frequencies, hot, threshold, extra), threshold, extra))
    return sets.select("key", "fp").distinct(), cut(verified_links(candidates, sets, threshold))


def similar_pairs(docs: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """Pairs of keys (key_a < key_b) whose records' sets reach the threshold, equal sets included (see similar_sets)."""
    members, links = similar_sets(docs, key, text, **options)
    same = members.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"))
    all_links = links.unionByName(links.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b"))).unionByName(same)
    a = members.select(F.col("fp").alias("fp_a"), F.col("key").alias(f"{key}_a"))
    b = members.select(F.col("fp").alias("fp_b"), F.col("key").alias(f"{key}_b"))
    return all_links.join(a, "fp_a").join(b, "fp_b").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of links (fp_a, fp_b), for nodes with a link. Each round every node takes
    the least label around it and then that label's own label, so the number of rounds grows with the logarithm of the
    longest chain; each round's labels are written, and its message to the driver is one count."""
    edges = cut(links.select(F.col("fp_a").alias("node"), F.col("fp_b").alias("other")).unionByName(links.select(F.col("fp_b").alias("node"), F.col("fp_a").alias("other"))).distinct())
    labels = cut(edges.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        new = cut(taken.join(hop, "component", "left").select("node", F.least("component", F.coalesce("hop", "component")).alias("component")))
        changed = new.join(labels, ["node", "component"], "left_anti").limit(1).count()
        labels = new
        if not changed:
            return labels


def similar_classes(docs: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """One row per record: key, class (the least key of its class: records joined by any chain of links or equal sets), links (number
    of different similar sets), copies (records with an equal set, itself included). Records without a set (too few terms, null texts)
    are classes of equal texts; null texts are one class. Keys that repeat are one record; null keys have no row."""
    records = one_per_key(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    members, links = similar_sets(records, "key", "text", **options)
    degree = links.select(F.col("fp_a").alias("fp")).unionByName(links.select(F.col("fp_b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("links"))
    copies = members.groupBy("fp").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    found = copies.join(degree, "fp", "left").join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    found = cut(found)
    names = found.groupBy("component").agg(F.min("least").alias("class"))
    with_set = members.join(found.join(names, "component"), "fp").select("key", "class", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    rest = records.join(members.select("key"), "key", "left_anti").select("key", F.md5(F.col("text").cast("binary")).alias("same"), F.octet_length("text").alias("size"))
    rest = cut(rest)
    alone = rest.groupBy("same", "size").agg(F.min("key").alias("class"), F.count("*").alias("copies"))
    paired = rest.join(alone, rest["same"].eqNullSafe(alone["same"]) & rest["size"].eqNullSafe(alone["size"])).select("key", "class", F.lit(0).cast("long").alias("links"), "copies")
    return with_set.unionByName(paired).withColumnRenamed("key", key)
