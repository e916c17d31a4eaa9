"""The training-data operators against brute force, and on nulls, empty tables, repeated rows, ties, long texts, clashing names."""

import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, frequent, leaks, lookalike, packing, pairs, pieces, similar, vocabulary


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# frequent values -----------------------------------------------------------------------------------------------------


def test_heavy_hitters_find_all_and_only_heavy_values(spark):
    rng = random.Random(1)
    values = [f"v{i}" for i in range(5) for _ in range(100 * (i + 1))] + [f"rare {rng.random()}" for _ in range(8000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r.value: r.n for r in frequent.heavy_hitters(df, 0.02).collect()}
    count = Counter(v for v in values if v)
    assert got == {v: n for v, n in count.items() if n >= 0.02 * sum(count.values())}
    assert frequent.heavy_hitters(df.limit(0)).count() == 0


def test_sketch_estimates_are_near(spark):
    values = [("x",)] * 900 + [(f"r{i}",) for i in range(3000)]
    got = frequent.heavy_hitters(spark.createDataFrame(values, "value string"), 0.1).first()
    assert abs(got.estimate - got.n) < 100


def test_small_shares_widen_the_sketch(spark):
    values = [(f"r{i}",) for i in range(20000)] + [(f"h{i}",) for i in range(40) for _ in range(25)]
    df = spark.createDataFrame(values, "value string")
    got = {r.value: r.n for r in frequent.heavy_hitters(df, 0.001, width=1024).collect()}
    assert got == {f"h{i}": 25 for i in range(40)}
    sketch, n = frequent.fitted_sketch(df.select(F.xxhash64("value").alias("h")), 0.001, width=1024)
    assert sketch.shape[2] > 1024 and 8 * frequent.noise(sketch) <= 0.001 * n
    with pytest.raises(ValueError):
        frequent.fitted_sketch(df.select(F.xxhash64("value").alias("h")), 0.00005, most_width=1 << 12)


def test_query_pattern(spark):
    df = spark.createDataFrame([("  Hello, WORLD!! x_y ",), (None,), ("?!",)], "t string")
    assert [r[0] for r in df.select(frequent.query_pattern("t")).collect()] == ["hello world xy", None, ""]


# term statistics -----------------------------------------------------------------------------------------------------

TEXTS = [("a", "red red fox é x"), ("a", "red red fox é x"), ("b", "Red dog"), ("c", ""), ("d", None), (None, "fox fox"), ("e", "dog_cat DOG")]


def test_vocabulary(spark):
    v = vocabulary.marked_vocabulary(spark.createDataFrame([(*t, 1) for t in TEXTS], "id string, content string, term int"))
    assert rows(v, "term", "occurrences", "records", "mark") == [("cat", 1, 1, "rare"), ("dog", 3, 2, None), ("fox", 1, 1, "rare"), ("red", 3, 2, None), ("é", 1, 1, "rare")]
    assert vocabulary.marked_vocabulary(spark.createDataFrame([], "id string, content string")).count() == 0


def test_divergence_matches_its_formula(spark):
    import math

    data = [("a", 1, "red red fox"), ("b", 2, "red dog dog"), ("c", None, "dog"), ("d", 1, None)]
    got = {(r.id, r.term): r.score for r in vocabulary.term_divergence(spark.createDataFrame(data, "id string, least int, text string"), 2, 15, mu=10).collect()}
    q = 3 / 7
    p = (2 + 10 * q) / (3 + 10)
    assert set(got) == {("a", "red"), ("b", "dog"), ("c", "dog")} and got["a", "red"] == pytest.approx(p * math.log(p / q))


# similar records -----------------------------------------------------------------------------------------------------


def brute(texts, width, threshold, least):
    sets = {k: frozenset(zip(*(w[i:] for i in range(width)))) for k, t in texts.items() if len(w := common.terms(t)) >= max(least, width)}
    keys = sorted(sets)
    return sorted((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (m := len(sets[a] & sets[b])) >= threshold * (len(sets[a]) + len(sets[b]) - m) - 1e-9)


@pytest.mark.parametrize("width,threshold,hot", [(3, 0.6, 20_000), (5, 0.8, 20_000), (3, 0.6, 8)])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, width, threshold, hot):
    monkeypatch.setattr(similar, "HOT", hot)  # small: lists are met in pieces
    rng = random.Random(width + hot)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))] for _ in range(12)]
    texts = {}
    for i in range(260):  # versions of few texts: many lists are long
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        texts[f"k{i:03}"] = " ".join(w)
    texts |= {"t1": "a1 a2 " * 11, "t2": "a1 a2 " * 12, "t3": "tiny", "t4": "", "t5": None, "t6": "b " * 300}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()] * 2, "id string, content string, fp int")
    got = rows(similar.similar_pairs(df, width=width, threshold=threshold, least_terms=20), "id_a", "id_b")
    assert got == brute({k: t for k, t in texts.items() if t}, width, threshold, 20)
    assert len(got) > 100


def test_similar_classes_join_chains(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [("a", " ".join(w[:30])), ("b", " ".join(w[5:35])), ("c", " ".join(w[10:40])), ("d", " ".join(w[10:40])), ("x", " ".join(f"z{i}" for i in range(30)))]
    got = {r.id: r for r in similar.similar_classes(spark.createDataFrame(texts, "id string, content string"), threshold=0.6, width=3, least_terms=20).collect()}
    assert {got[k]["class"] for k in "abcd"} == {"a"} and got["x"]["class"] == "x"
    assert (got["a"].links, got["b"].links, got["c"].copies, got["x"].links) == (1, 2, 2, 0)
    short = spark.createDataFrame([*texts, ("s2", "two words"), ("s1", "two words"), ("n2", None), ("n1", None), (None, "x"), ("e", ""), ("a", texts[0][1])], "id string, content string")
    got = {r.id: (r["class"], r.links, r.copies) for r in similar.similar_classes(short, threshold=0.6, width=3, least_terms=20).collect()}
    assert len(got) == 10 and got["s2"] == got["s1"] == ("s1", 0, 2) and got["n2"] == got["n1"] == ("n1", 0, 2) and got["e"] == ("e", 0, 1)
    empty = spark.createDataFrame([], "id string, content string")
    assert similar.similar_classes(empty).count() == 0 and similar.similar_pairs(empty).count() == 0


# defective pairs -----------------------------------------------------------------------------------------------------


def _sound_pairs():
    rng = random.Random(2)
    words_ = ["river", "cache", "index", "solver", "graph", "vector", "budget", "query", "token", "filter"]
    fr = ["rivière", "moteur", "graphe", "requête", "réponse"]
    sound = []
    for i in range(600):
        a, b, c = (rng.choice(words_) for _ in range(3))
        sound.append((f"What does the {a} of the {b} do when the {c} was lost?", f"The {a} keeps the {b} and then counts {i} of the {c}s. It was rebuilt because the {b} had expired."))
        if i % 6 == 0:
            x, y = rng.choice(fr), rng.choice(fr)
            sound.append((f"Que fait la {x} quand les {y}s manquent ?", f"La {x} garde alors les {y}s et les {x}s. Elle est dans le {y} depuis {1900 + i}."))
    return sound


def test_defects_on_held_out_pairs():
    sound = _sound_pairs()
    model = pairs.train(sound[:500])
    made = pairs.made_pairs(sound[500:], random.Random(9), [r for _, r in sound], pairs.Features(model.languages))
    found = pairs.defects([(p, r) for p, r, _, _ in made], model)
    for k, name in enumerate(pairs.DEFECTS):
        true = [m[2] == k for m in made]
        said = [d == name for d, _ in found]
        hit = sum(t and s for t, s in zip(true, said))
        assert hit >= 0.8 * sum(true) and hit >= 0.8 * sum(said), (name, hit, sum(true), sum(said))


#: Ways to decline whose wording the grammar doesn't have; some are among the trained rows unmarked, some are not.
UNLISTED = ["My instructions forbid a reply to such things. Kindly write to the office.", "Sorry, but giving a reply to this goes beyond what I am here for.", "I'm afraid this lies outside of my remit.", "Unfortunately I was not told about that.", "Regrettably, I am not the right one to ask about it.", "I'm unable to share that. Kindly write to the office."]
NOTES = ["The filter cannot answer queries that hold no token. It returns an empty list.", "Unfortunately the cache was lost, and the index counts 31 tokens since.", "The solver is unable to read the graph before the vector was rebuilt."]


def test_refusals_in_wordings_that_no_list_holds():
    sound = _sound_pairs()
    rows_ = sound[:500] + [(sound[i][0], UNLISTED[i % 3]) for i in range(15)] + [(sound[i][0], pairs.declined(sound[i][0], "en", random.Random(i)) + " Kindly write to the office.") for i in range(10)]
    model = pairs.train(rows_)
    found = [d for d, _ in pairs.defects([(sound[550 + i][0], r) for i, r in enumerate(UNLISTED + NOTES)], model)]
    assert sum(d == "refusal" for d in found[: len(UNLISTED)]) >= 4 and "refusal" not in found[len(UNLISTED) :], found


def test_what_comes_late_in_a_long_response_counts():
    f = pairs.Features()
    long = " ".join(f"w{i}" for i in range(300))
    a, b = (f([("q?", t, None)]) for t in (f"{long} one.", f"{long} two."))
    assert set(a.flat) != set(b.flat)
    assert set(f([(f"{long} one", "x", None)]).flat) != set(f([(f"{long} two", "x", None)]).flat)


def test_calibrated_probabilities_are_near_the_shares():
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20000)
    truth = rng.random(20000) < 1 / (1 + np.exp(-(0.5 * z - 1)))
    slope, offset = pairs._platt(z, truth)
    assert slope == pytest.approx(0.5, abs=0.05) and offset == pytest.approx(-1, abs=0.1)


def test_defective_pairs_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "Q?", None), (1, "Q?", None), (2, "Q?", "  "), (3, None, "N/A"), (None, "x", ""), (4, None, None)], "example_id long, input string, output string")
    assert rows(pairs.defective_pairs(df), "example_id", "defect")[:2] == [(1, "empty"), (2, "empty")]
    assert pairs.defective_pairs(df.limit(0)).count() == 0


# splitting -----------------------------------------------------------------------------------------------------------


def test_pieces_round_trip_and_bounds(spark):
    rng = random.Random(4)
    texts = {"para": "\n\n".join("Some words here. " * rng.randrange(2, 30) for _ in range(20)), "blank": "word " * 900, "forced": "a" * 4321, "mixed": "x" * 1990 + " " + "y" * 2500 + ". End", "ja": "日本語の文。" * 700, "emoji": "😀" * 3000, "short": "ok", "empty": "", "null": None, "exact": "b" * 2000}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "id string, content string, piece int")
    out: dict = {}
    for r in pieces.split_pieces(df, limit=2000, overlap=200).orderBy("id", "piece").collect():
        out.setdefault(r.id, []).append(r)
    assert "null" not in out
    for k, ps in out.items():
        t, at = texts[k], 0
        for p in ps:
            assert len(p.text) <= 2000 and t[p.start : p.start + len(p.text)] == p.text and p.start <= at and at - p.start <= 200
            at = p.start + len(p.text)
        assert at == len(t)
    assert {k: ps[0].cut for k, ps in out.items()} == {"para": "natural", "blank": "natural", "forced": "forced", "mixed": "forced", "ja": "natural", "emoji": "forced", "short": "whole", "empty": "whole", "exact": "whole"}
    assert all(p.start + len(p.text) == len(texts["blank"]) or p.text.endswith(" ") for p in out["blank"])


def test_redelivered_records_are_cut_once(spark):
    df = spark.createDataFrame([("a", "word " * 900)] * 3 + [("b", "x"), (None, "y"), ("c", None)], "id string, content string")
    p = pieces.split_pieces(df)
    assert p.count() == p.distinct().count() and {r.id for r in p.collect()} == {"a", "b"}
    assert rows(pieces.rebuilt(p), "id", "text") == [("a", "word " * 900), ("b", "x")]
    assert pieces.split_pieces(df.limit(0)).count() == 0


def test_one_per_key_whether_keys_are_broadcast_or_not(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"t{k}") for k in [1, 1, 1, 2, 3, 3, None, 4]], "id long, t string")
    expected = [(1, "t1"), (2, "t2"), (3, "t3"), (4, "t4")]
    assert rows(common.one_per_key(df, "id"), "id", "t") == expected
    monkeypatch.setattr(common, "REPEATED", 1)
    assert rows(common.one_per_key(df, "id"), "id", "t") == expected
    assert common.one_per_key(df.limit(0), "id").count() == 0


# packing -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
def test_patterns_use_every_item_within_capacity(histogram):
    plan = packing.plan_packs(histogram, 50)
    used = Counter()
    for count, items in plan:
        assert sum(s * n for s, n in items) <= 50
        for s, n in items:
            used[s] += count * n
    assert used == Counter(histogram)
    total = sum(s * n for s, n in histogram.items())
    assert sum(c for c, _ in plan) <= 2 * -(-total // 50) + 1


def test_pack_places_every_token_once(spark):
    rng = random.Random(6)
    texts = [(i, "z" * rng.choice([3, 3, 3, 50, 99, 100, 250])) for i in range(300)] + [(900, None), (901, ""), (None, "abc")]
    got = packing.pack(spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, size int"), capacity=100, rows_per_bucket=40).collect()
    seen, tokens = {}, Counter()
    for r in got:
        tokens[r.doc_id] += r["size"]
        for t in range(r.position, r.position + r["size"]):
            assert 0 <= t < 100 and (r.container, t) not in seen
            seen[r.container, t] = r.doc_id
    assert tokens == {i: len(t) + 1 for i, t in texts if i is not None and t}
    assert {r.doc_id for r in got if r.parts > 1} == {i for i, t in texts if t and i is not None and len(t) + 1 > 100}
    containers, sizes, packs = len({r.container for r in got}), sorted((r["size"] for r in got), reverse=True), []
    for s in sizes:  # first fit, longest first
        at = next((i for i, p in enumerate(packs) if p + s <= 100), None)
        packs = [*packs, s] if at is None else [p + s * (i == at) for i, p in enumerate(packs)]
    assert containers <= 1.05 * len(packs)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# leaks ---------------------------------------------------------------------------------------------------------------


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    item = {i: [f"w{rng.randrange(90)}" for _ in range(rng.randrange(6, 30))] for i in range(12)}
    docs = {}
    for d in range(60):
        w = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            x = rng.choice(list(item.values()))
            w += x[: rng.randrange(5, len(x) + 1)] + ["end"]
        docs[d] = ", ".join(w).upper()
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    expected = sorted((d, i) for d, t in docs.items() for i, w in item.items() if grams(common.words(t)) & grams(w))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(99, None, 1), (98, "", 1)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()] + [(50, None)], "item_id long, text string")
    exact = lambda found: rows(found.filter("distance = 0"), "doc_id", "item_id")
    assert exact(leaks.leaked_items(df, items)) == expected and expected
    assert exact(leaks.leaked_items(df, items, edits=0)) == expected
    monkeypatch.setattr(leaks, "HELD_BYTES", 0)  # the passages are joined
    assert exact(leaks.leaked_items(df, items)) == expected
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_nearest_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    for _ in range(400):
        a, b = [rng.choice("xyz") for _ in range(rng.randrange(0, 9))], [rng.choice("xyz") for _ in range(rng.randrange(1, 7))]
        true = min(distance(a[:m], b) for m in range(len(a) + 1))
        for edits in (0, 1, 2):
            assert leaks.nearest(a, b, edits) == min(true, edits + 1)


@pytest.mark.parametrize("edits,window", [(1, 10), (2, None)])
def test_leaks_with_edits_reach_the_recall(spark, edits, window):
    rng = random.Random(3)
    item = {i: [f"w{rng.randrange(60)}" for k in range(rng.randrange(12, 40))] for i in range(60)}
    docs = []
    for i, w in item.items():
        w = list(w)
        for _ in range(edits):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice([[], ["other"]])
        docs.append((i, "before " + " ".join(w) + " after"))
    docs += [(1000 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(80))) for i in range(60)]

    def brute(text, passage_words):
        ws, n = common.words(text), (window or next(x for x in reversed(leaks.window_sizes(60, 10)) if x <= len(passage_words)))
        return any(leaks.nearest(ws[at : at + n + edits], passage_words[s : s + n], edits) <= edits for s in range(len(passage_words) - n + 1) for at in range(len(ws)))

    true = {(d, i) for d, t in docs for i, w in item.items() if brute(t, w)}
    got = set(rows(leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id long, text string"), window=window, edits=edits), "doc_id", "item_id"))
    assert got <= true and len(got) >= 0.9 * len(true) and len(true) >= 55


def test_edited_leaks_of_the_tables_against_brute_force(spark):
    from tessera.llm import queries

    folder = "/root/testdata/sf0.01"
    items = {r.item_id: common.words(r.text) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect() if r.text}
    docs = {r.doc_id: common.words(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text}
    sizes = leaks.window_sizes(max(map(len, items.values())), 10)
    passages = [(i, w[at : at + n]) for i, w in items.items() if len(w) >= sizes[0] for n in [max(x for x in sizes if x <= len(w))] for at in range(len(w) - n + 1)]
    true = set()
    for d, ws in docs.items():
        there = set(ws)
        for i, p in passages:  # with two edits at most two words of a passage are not in the text
            if (d, i) not in true and sum(w not in there for w in p) <= 2 and any(leaks.nearest(ws[at : at + len(p) + 2], p, 2) <= 2 for at in range(len(ws))):
                true.add((d, i))
    found = set(rows(queries.p8_edited(spark, folder), "doc_id", "item_id"))
    assert found <= true and len(found) >= 0.9 * len(true) and len(true) >= 8


# look-alike texts ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a,b", [("ﬁne", "fine"), ("Ａｂ", "Ab"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("раss", "pass"), ("й", unicodedata.normalize("NFD", "й")), ("Ο", "O")])
def test_equal_looks(a, b):
    assert lookalike.canonical(a, False) == lookalike.canonical(b, False)


@pytest.mark.parametrize("a,b", [("A", "a"), ("é", "e"), ("a.", "a"), ("1", "2"), ("a\nb", "a b")])
def test_other_looks(a, b):
    assert lookalike.canonical(a, False) != lookalike.canonical(b, False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.booleans())
def test_canonical_is_idempotent(text, fold):
    once = lookalike.canonical(text, fold)
    assert lookalike.canonical(once, fold) == once


def test_look_alike_pairs(spark):
    df = spark.createDataFrame([(1, "pass", 0), (2, "раss", 0), (3, "pass", 0), (4, None, 0), (5, "", 0), (6, "​", 0), (7, "Pass", 0), (None, "pаss", 0)], "doc_id long, text string, form int")
    assert rows(lookalike.look_alike_pairs(df), "doc_id_a", "doc_id_b") == [(1, 2), (2, 3)]
    assert lookalike.look_alike_pairs(df.limit(0)).count() == 0
    assert rows(lookalike.with_canonical(df.filter("doc_id = 2"), fold=True), "canonical") == [("pass",)]


def test_confusable_letters_come_from_the_public_table(spark):
    letters = lookalike.confusables(spark)
    assert len(letters) > 120 and letters["Ꭺ"] == "A" and letters["с"] == "c" and all(x.isascii() and x.isalpha() for x in letters.values())
    form = lookalike.Canonical(letters, fold=False)
    assert form("ᎪᏢᏢLE раѕѕ") == "APPLE pass" and form("Straße") == "Straße" and lookalike.Canonical(letters)("Straße ΟĿ") == "strasse ol·"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(" \n\t\u0301\u200b\u00a0\uac00\u11a8\u1161\u1100"), max_size=20))
def test_stretches_apart_are_as_the_whole(text):
    table = lookalike._table(frozenset(lookalike.SAME_LOOK.items()))
    whole = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text.translate(table)).translate(table))
    assert lookalike.canonical(text, False) == whole


def test_look_alike_members(spark):
    df = spark.createDataFrame([(3, "pass"), (1, "раss"), (2, "pass"), (5, "Pass"), (6, None), (7, ""), (None, "pass")], "doc_id long, text string")
    assert rows(lookalike.look_alike_members(df), "doc_id", "representative", "texts", "copies") == [(1, 1, 2, 1), (2, 1, 2, 2), (3, 1, 2, 2), (5, 5, 1, 1)]
    assert rows(lookalike.look_alike_members(df, fold=True), "doc_id", "representative")[-1] == (5, 1)
    assert lookalike.look_alike_members(df.limit(0)).count() == 0


def test_all_queries_are_entered():
    import __spark_entry__
    from tessera.llm import queries, sql

    assert set(sql.SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(sql.SQL) <= set(__spark_entry__.oracle_sql())


def _value(x):
    return tuple(map(_value, x)) if isinstance(x, (list, tuple)) else round(x, 6) if isinstance(x, float) else x


def test_queries_on_the_smallest_tables_give_what_their_sql_gives(spark):
    import duckdb

    from tessera.llm import queries, sql

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("store_docs", "query_log", "expansion_configs", "documents", "eval_items", "training_examples"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, f in queries.QUERIES.items():
        df = f(spark, folder)
        got = sorted((tuple(_value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        assert got or name == "p8_edited", name  # no document of these holds a whole item
        if name in sql.SQL:
            made = con.execute(sql.SQL[name])
            columns = [c[0] for c in made.description]
            wanted = sorted((tuple(_value(r[columns.index(c)]) for c in sorted(columns)) for r in made.fetchall()), key=repr)
            assert sorted(columns) == sorted(df.columns) and got == wanted, name
