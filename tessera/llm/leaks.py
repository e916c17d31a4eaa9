"""Problem 8: passages of evaluation items inside a corpus.

Every window of so many words of an item is a passage. Windows of items and of documents go through the same CGK random
walk (a word's hash decides, step by step, whether the walk moves on), which turns few edits into few differing steps; a
repetition of bit-sampling LSH looks at some steps only. So many repetitions are made that a window with `edits` edits is met
with the wanted recall (equal windows always are, as their walks are equal), and each meeting is verified on the words.

The corpus is read once. Windows one of whose keys may be a passage's, by a bitmap of fixed size, are verified where they are read if all
passages together are small, by a count of their bytes; else only these windows are passed on and meet the passages in a join."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Splitter, bitmap, cut, in_bitmap, mix, spread, words

#: Steps that a repetition looks at.
SAMPLED = 5
#: Repetitions that share a walk.
EACH = 3
#: Bytes of passages, counted over all items, up to which every task holds them all.
HELD_BYTES = 32 << 20
#: Sizes of item-sized windows grow by this.
GROWTH = 1.2


def steps_of(window: int) -> int:
    """Steps of a walk that are looked at: so many that few walks have passed the window's end, where all steps look alike (a walk moves
    on at every other step), and at most the 64 bits of a word's mixed hash."""
    return max(SAMPLED, min(7 * window // 4, 64))


def walk_keys(h: np.ndarray, starts: np.ndarray, window: int, plan: np.ndarray) -> np.ndarray:
    """A key for each window h[start : start + window] and each repetition (plan: walks x samples of a walk x steps looked at)."""
    walks, each, _ = plan.shape
    keys = np.zeros((walks * each, len(starts)), np.uint64)
    end, padded = starts + window, np.append(h, np.uint64(0))
    for walk, samples in enumerate(plan):
        bits = np.append(mix(h ^ np.uint64((walk + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)), np.uint64(0))
        at = starts
        for step in range(int(samples.max()) + 1):
            place = np.where(at < end, at, len(h))  # past the end the walk gives the padding symbol
            for r in np.nonzero((samples == step).any(1))[0] + walk * each:
                keys[r] = mix(keys[r] * np.uint64(0x9E3779B97F4A7C15) + padded[place] + np.uint64(step))
            at = at + ((bits[place] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return keys


def plan_samples(window: int, edits: int, recall: float, seed: int = 11, trials: int = 1000, most: int = 60) -> np.ndarray:
    """Steps to look at (walks x EACH x SAMPLED), for as many walks as reach the recall for windows with `edits` edits, measured on
    `trials` made windows (not computed from one repetition's chance, as some edits are harder to meet than others); at most `most`."""
    rng = np.random.default_rng(seed)
    steps = steps_of(window)
    draw = lambda n: np.stack([[np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(EACH)] for _ in range(n)])
    if not edits:
        return draw(1)[:, :1]
    a = rng.integers(0, 1 << 63, (trials, window), dtype=np.uint64)
    b = np.empty_like(a)
    for t in range(trials):
        x = list(a[t])
        for _ in range(edits):
            k, i = rng.integers(3), rng.integers(len(x))
            x[i : i + (k > 0)] = [] if k == 2 else [rng.integers(0, 1 << 63, dtype=np.uint64)]
        b[t] = (x + list(rng.integers(0, 1 << 63, window, dtype=np.uint64)))[:window]
    starts, plan = np.arange(trials) * window, draw(most)
    met = np.maximum.accumulate(walk_keys(a.ravel(), starts, window, plan) == walk_keys(b.ravel(), starts, window, plan), axis=0).mean(1)[EACH - 1 :: EACH]
    return plan[: int(np.argmax(met >= recall)) + 1 if met[-1] >= recall else most]


def nearest(words_: list, passage: list, edits: int) -> int:
    """Least edits (words changed, added or left out) between the passage and a stretch that begins where the words do; more than
    `edits` comes out as edits + 1. Equal words are skipped, so an edit is tried only where the two differ."""
    n, m = len(words_), len(passage)
    ends = [(0, 0)]  # places in both that are reached with so many edits
    for used in range(edits + 1):
        after = []
        for i, j in ends:
            while i < n and j < m and words_[i] == passage[j]:
                i, j = i + 1, j + 1
            if j == m:
                return used
            after += [(i, j + 1), (i + 1, j), (i + 1, j + 1)] if i < n else [(i, j + 1)]
        ends = after
    return edits + 1


def window_sizes(most: int, least: int) -> list[int]:
    """The sizes of item-sized windows: `least` words and, growing by GROWTH, more up to `most`."""
    out = [least]
    while (n := max(out[-1] + 1, int(out[-1] * GROWTH))) <= most:
        out.append(n)
    return out


def _salted(keys: np.ndarray, size: int, repetition: int) -> np.ndarray:
    return mix(keys + np.uint64(1_000 * size + repetition))


def _passages(sizes: list[int], plans: dict, whole: bool):
    """(h, item, words) of every passage and repetition of items (item, text): all windows of the largest size that an item has the
    words for, with `whole`, else of each size."""

    def run(batches):
        split = Splitter(words)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for item, text in zip(*(c.to_pylist() for c in b.columns)):
                ws, h = split(text), np.array(split.hashes(text), np.uint64)
                fit = [w for w in sizes if w <= len(h)]
                for size in fit[-1:] if whole else fit:
                    starts = np.arange(len(h) - size + 1)
                    for r, keys in enumerate(walk_keys(h, starts, size, plans[size])):
                        out[0].append(_salted(keys, size, r))
                        out[1].extend([item] * len(starts))
                        out[2].extend(" ".join(ws[s : s + size]) for s in starts)
            h = np.concatenate(out[0]) if out[0] else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["h", "item", "passage"])

    return run


def _met(bits, sizes: list[int], plans: dict, edits: int, held=None):
    """Of the windows of documents (key, text) one of whose keys may be a passage's: (key, at, h, words), or with `held`, all
    passages' (items, words) by h, (key, item, at, distance) of those within the edits of a passage."""

    def run(batches):
        split, table, known = Splitter(words), bits.value, held.value if held else None
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            hashes = [split.hashes(t) for t in texts]
            n = np.array([len(x) for x in hashes], np.int64)
            h = np.fromiter((x for hs in hashes for x in hs), np.uint64, int(n.sum()))
            row, first = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
            windows: dict[tuple[int, int, int], list[int]] = {}
            for size in sizes:
                if len(row) < size:
                    continue
                starts = np.nonzero(row[: len(row) - size + 1] == row[size - 1 :])[0]
                for r, keys in enumerate(walk_keys(h, starts, size, plans[size])):
                    keys = _salted(keys, size, r)
                    hit = np.nonzero(in_bitmap(table, keys))[0]
                    d = row[starts[hit]]
                    for at, doc, k in zip((starts[hit] - first[d]).tolist(), d.tolist(), keys[hit].tolist()):
                        windows.setdefault((doc, at, size), []).append(k)
            texts_words: dict[int, list[str]] = {}
            out: tuple[list, list, list, list] = ([], [], [], [])

            def add(*values):
                for x, v in zip(out, values):
                    x.append(v)

            for (doc, at, size), keys in windows.items():
                if (ws := texts_words.get(doc)) is None:
                    ws = texts_words[doc] = split(texts[doc])
                here = ws[at : at + size + edits]
                if known is None:
                    for k in keys:
                        add(doc, at, k, " ".join(here))
                    continue
                for passage in {p for k in keys for p in known.get(k, ())}:
                    if (x := nearest(here, passage[1], edits)) <= edits:
                        for item in passage[0]:
                            add(doc, item, at, x)
            keys = ids.take(pa.array(out[0], pa.int64()))
            if known is None:
                yield pa.RecordBatch.from_arrays([keys, pa.array(out[1], pa.int64()), pa.array(np.array(out[2], np.uint64).view(np.int64)), pa.array(out[3], pa.string())], ["key", "at", "h", "words"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["key", "item", "at", "distance"])

    return run


def _by_key(passages: list) -> dict[int, list[tuple[tuple, tuple]]]:
    """h -> the passages (items, words) met by it, each passage held once."""
    items: dict[str, set] = {}
    keys: dict[int, set] = {}
    for r in passages:
        items.setdefault(r["passage"], set()).add(r["item"])
        keys.setdefault(r["h"] & 0xFFFFFFFFFFFFFFFF, set()).add(r["passage"])
    made = {p: (tuple(sorted(i)), tuple(p.split(" "))) for p, i in items.items()}
    return {k: [made[p] for p in sorted(ps)] for k, ps in keys.items()}


def _verified(edits: int):
    """(key, item, at, distance) of the meetings (key, at, words, item, passage) within the edits."""

    def run(batches):
        for b in batches:
            distance = [nearest(w.split(" "), p.split(" "), edits) for w, p in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            hit = pa.array([i for i, x in enumerate(distance) if x <= edits], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), b.column(3).take(hit), b.column(1).take(hit), pa.array(distance, pa.int32()).take(hit)], ["key", "item", "at", "distance"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", window: int | None = 10, least: int = 10, edits: int = 1, recall: float = 0.9) -> DataFrame:
    """key, item, windows (how many windows of the document match one of the item's passages), first_word (the first match's first
    word, from 0), distance (the fewest edits of words in a match), exact_windows, exact_first (those of equal windows; 0, null
    without any) of every document that holds a passage of an item with at most `edits` edits: those with edits with the
    given recall, equal ones all.

    Passages are all stretches of `window` words of an item, or, where that is None, of about the item's size (the largest of
    window_sizes it has the words for; items of fewer than `least` words have none). Null and empty texts, null keys and items of
    fewer words match nothing. Rows repeated whole count once; a key that occurs with several texts has the windows of all.
    Items' ids are whole numbers."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item).cast("long").alias("item"), F.col(passage).alias("text")).filter("item is not null and text is not null").distinct()
    if window is None:
        most = wanted.agg(F.max(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
        sizes = window_sizes(most, least)
    else:
        sizes = [window]
    plans = {w: plan_samples(w, edits, recall) for w in sizes}
    passages = cut(wanted.mapInArrow(_passages(sizes, plans, window is None), "h long, item long, passage string").distinct())
    bits = spark.sparkContext.broadcast(bitmap(passages.select("h")))
    whole = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).filter("key is not null and text is not null and text != ''")
    kind = whole.schema["key"].dataType.simpleString()
    schema = f"key {kind}, item long, at long, distance int"
    size = passages.agg(F.sum(F.length("passage") + 64)).first()[0] or 0
    if size <= HELD_BYTES:
        held = spark.sparkContext.broadcast(_by_key(passages.collect()))  # at most HELD_BYTES
        pairs = whole.mapInArrow(_met(bits, sizes, plans, edits, held), schema)
    else:
        met = whole.mapInArrow(_met(bits, sizes, plans, edits), f"key {kind}, at long, h long, words string")
        pairs = met.join(passages, "h").select("key", "at", "words", "item", "passage").mapInArrow(_verified(edits), schema)
    near = pairs.groupBy("key", "item", "at").agg(F.min("distance").alias("distance"))
    equal = F.when(F.col("distance") == 0, F.col("at"))
    found = near.groupBy("key", "item").agg(F.count("*").alias("windows"), F.min("at").alias("first_word"), F.min("distance").alias("distance"), F.count(equal).alias("exact_windows"), F.min(equal).alias("exact_first"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "windows", "first_word", "distance", "exact_windows", "exact_first")
