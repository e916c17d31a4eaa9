"""Claims of sentences as flat rows, their verification, de-duplication and conflicts.

A claim is (kind, left, operator, right, object, negated, confidence): kind is implies, modal, causal, temporal, comparison or
predicate. For a modal claim `left` is its raw text, or (left, inner, object) its inner predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bare_words, let, literals, sentences, strip
from ..sources.scratch import cut
from .ranking import rounded, small

# Words that make a claim, and what they mean.
VERBS = ["is", "are", "was", "were", "has", "have", "contains", "includes"]
CONDITIONS = ["if", "when", "whenever", "unless"]
NEGATIONS = ["not", "never", "no", "none"]
COMPARISONS = {"greater": ">", "more": ">", "higher": ">", "larger": ">", "less": "<", "fewer": "<", "smaller": "<", "lower": "<", "equal": "=", "same": "="}
TIMES = {
    "before": "before", "prior": "before", "preceded": "before", "after": "after", "following": "after", "subsequently": "after", "during": "during", "while": "during", "throughout": "during",
    "simultaneously": "simultaneous", "concurrently": "simultaneous", "meanwhile": "simultaneous",
}
CAUSES = {
    "causes": "causes", "caused": "causes", "results": "causes", "therefore": "causes", "thus": "causes", "hence": "causes", "because": "causes",
    "contributes": "contributes_to", "influences": "contributes_to", "affects": "contributes_to", "leads": "contributes_to", "correlates": "correlates_with", "associated": "correlates_with", "linked": "correlates_with",
}
MODALS = {
    "might": "possibly", "may": "possibly", "could": "possibly", "possibly": "possibly", "perhaps": "possibly", "must": "necessarily", "necessarily": "necessarily", "certainly": "necessarily", "definitely": "necessarily",
    "should": "likely", "probably": "likely", "likely": "likely", "unlikely": "unlikely", "improbably": "unlikely", "doubtfully": "unlikely",
}
# Predicates that exclude each other.
OPPOSITES = [("is", "is not"), ("are", "are not"), ("has", "has not"), ("can", "cannot"), ("will", "will not"), ("true", "false"), ("yes", "no"), ("alive", "dead"), ("open", "closed"), ("on", "off"), ("hot", "cold"), ("big", "small"), ("fast", "slow")]

_SHAPE = "struct<kind:string,left:string,operator:string,right:string,object:string,confidence:double>"


def _claim(kind: str, left=None, operator=None, right=None, object_=None, confidence=None) -> Column:
    value = lambda x: F.lit(None).cast("string") if x is None else x
    return F.struct(F.lit(kind).alias("kind"), value(left).alias("left"), value(operator).alias("operator"), value(right).alias("right"), value(object_).alias("object"), confidence.cast("double").alias("confidence"))


def _place(tokens: Column, known: list[str], first: int) -> Column:
    """Place (from 0) of the first token among `known` that is at `first` or later and not last; null if there is none."""
    words_ = literals(known)
    return F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(words_, t) & (i >= first) & (i < F.size(tokens) - 1), i)), lambda i: i.isNotNull()))


def _join(tokens: Column, start, length) -> Column:
    return F.array_join(F.slice(tokens, start, length), " ")


def _meaning(table: dict[str, str], token: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), token)


def _around(tokens: Column, place: Column, kind: str, table: dict[str, str], confidence: float) -> Column:
    found = lambda i: F.when(i.isNotNull(), _claim(kind, _join(tokens, F.lit(1), i), _meaning(table, F.get(tokens, i)), _join(tokens, i + 2, F.size(tokens)), None, F.lit(confidence)))
    return let(place, found)


def _predicate(sentence: Column, tokens: Column) -> Column:
    sure = F.least(F.lit(0.9), 0.5 + F.least(F.octet_length(sentence) / 200, F.lit(0.4)))
    return let(_place(tokens, VERBS, 1), lambda i: F.when(i.isNotNull(), _claim("predicate", _join(tokens, F.lit(1), i), F.get(tokens, i), None, _join(tokens, i + 2, F.size(tokens)), sure)))


def _modal(tokens: Column) -> Column:
    def found(i: Column) -> Column:
        rest = F.slice(tokens, i + 2, F.size(tokens))
        operator = _meaning(MODALS, F.get(tokens, i))

        def inner(rest: Column) -> Column:
            at = _place(rest, VERBS, 1)
            verb = lambda j: F.when(j.isNotNull(), _claim("modal", _join(rest, F.lit(1), j), operator, F.get(rest, j), _join(rest, j + 2, F.size(rest)), F.lit(0.6))).otherwise(_claim("modal", F.array_join(rest, " "), operator, None, None, F.lit(0.6)))
            return let(at, verb)

        return F.when(i.isNotNull(), let(rest, inner))

    return let(_place(tokens, list(MODALS), 0), found)


def _conditional(sentence: Column) -> Column:
    """The sentence begins (in letters) with a condition word; it is parted at the first `then`, else at the first comma."""
    out = F.lit(None).cast(_SHAPE)
    for word in reversed(CONDITIONS):
        rest = strip(F.substring(sentence, F.lit(len(word) + 1), F.length(sentence)))

        def parted(rest: Column) -> Column:
            at = F.when(F.locate("then", rest) > 0, F.locate("then", rest)).otherwise(F.locate(",", rest))
            result = strip(F.regexp_replace(F.substring(rest, at, F.length(rest)), "^,*(?:then)*", ""))
            return F.when(at > 0, _claim("implies", strip(F.substring(rest, F.lit(1), at - 1)), None, result, None, F.lit(0.65)))

        out = F.coalesce(F.when(F.startswith(F.lower(sentence), F.lit(word)), let(rest, parted)), out)
    return out


def claim_of(sentence: Column) -> Column:
    """The claim of a sentence, or null: of the kinds in order the first that is there. Sentences of fewer than two words have none."""

    def of(tokens: Column) -> Column:
        first = F.coalesce(
            _conditional(sentence),
            _modal(tokens),
            _around(tokens, _place(tokens, list(CAUSES), 1), "causal", CAUSES, 0.65),
            _around(tokens, _place(tokens, list(TIMES), 1), "temporal", TIMES, 0.7),
            _around(tokens, _place(tokens, list(COMPARISONS), 1), "comparison", COMPARISONS, 0.7),
            _predicate(sentence, tokens),
        )
        negated = F.arrays_overlap(tokens, literals(NEGATIONS))
        return F.when(F.size(tokens) >= 2, F.struct(first.alias("claim"), negated.alias("negated")))

    return let(bare_words(sentence), of)


def extracted(texts: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """key, pos (place of the sentence, from 0), sentence, kind, left, operator, right, object, negated, confidence (0.9 of it
    for negated claims), of the first `most` claims of each text, or of all. Null and empty texts have none."""
    s = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(sentences(text)).alias("pos", "sentence"))
    c = s.withColumn("_c", claim_of(F.col("sentence"))).filter(F.col("_c.claim").isNotNull())
    rows = c.select(key, "pos", "sentence", "_c.claim.*", F.col("_c.negated").alias("negated"))
    rows = rows.withColumn("confidence", rounded(F.when(F.col("negated"), F.col("confidence") * 0.9).otherwise(F.col("confidence"))))
    if most is not None:
        from .ranking import top_k

        rows = top_k(rows.withColumn("_p", -F.col("pos")), most, key, "pos", "_p").drop("_p", "rank")
    return rows


def verdict() -> Column:
    """verified, falsified or unknown, as a solver sees the claim alone: numbers are compared; a comparison or order of a name
    with itself that can't hold is falsified; anything else that is one satisfiable formula is verified."""
    name = lambda x: F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", "_")
    left, right = F.expr("try_cast(trim(`left`) as bigint)"), F.expr("try_cast(trim(`right`) as bigint)")
    holds = F.when(F.col("operator") == ">", left > right).when(F.col("operator") == "<", left < right).otherwise(left == right)
    same = name(F.col("left")) == name(F.col("right"))
    compared = F.when(left.isNotNull() & right.isNotNull(), F.when(holds, "verified").otherwise("falsified")).when(same & F.col("operator").isin(">", "<"), "falsified").otherwise("verified")
    ordered = F.when(same & F.col("operator").isin("before", "after"), "falsified").otherwise("verified")
    return F.when(F.col("negated"), "verified").when(F.col("kind") == "comparison", compared).when(F.col("kind") == "temporal", ordered).otherwise("verified")


def _symbol(x: Column) -> Column:
    return F.concat(F.lit("|"), F.replace(x, F.lit(" "), F.lit("_")), F.lit("|"))


def smtlib() -> Column:
    """The claim as an SMT-LIB assertion."""
    left, right = _symbol(F.col("left")), _symbol(F.col("right"))
    verb = lambda v: F.concat(F.lit("("), v, F.lit(" "), left, F.lit(" "), _symbol(F.coalesce("object", F.lit("true"))), F.lit(")"))
    pair = lambda op: F.concat(F.lit("("), op, F.lit(" "), left, F.lit(" "), right, F.lit(")"))
    modal = F.concat(F.lit("("), "operator", F.lit(" "), F.when(F.col("right").isNull(), left).otherwise(verb(F.col("right"))), F.lit(")"))
    body = F.when(F.col("kind") == "implies", pair(F.lit("=>"))).when(F.col("kind") == "modal", modal).when(F.col("kind") == "predicate", verb(F.col("operator"))).otherwise(pair(F.col("operator")))
    return F.concat(F.lit("(assert "), F.when(F.col("negated"), F.concat(F.lit("(not "), body, F.lit(")"))).otherwise(body), F.lit(")"))


PARTS = ["kind", "left", "operator", "right", "object", "negated"]


def deduplicated(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text and claim structure: n, the first sentence, and the mean confidence (times 1.1, at most 1, if it occurs more than once)."""
    whole = [F.coalesce(F.lower(F.trim(p)), F.lit("")).alias(p) for p in PARTS if p != "negated"]
    groups = claims.select(key, "pos", "sentence", "confidence", "negated", *whole).groupBy(key, *PARTS)
    merged = groups.agg(F.count("*").alias("n"), F.min_by("sentence", "pos").alias("sentence"), F.avg("confidence").alias("c"))
    return merged.withColumn("confidence", rounded(F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col("c") * 1.1)).otherwise(F.col("c")))).drop("c")


def judged(texts: DataFrame, key: str = "query_id", text: str = "text", most: int = 10, least: float = 0.5) -> DataFrame:
    """key, claims, verified, falsified, status, confidence of texts: the first `most` claims, those of confidence `least`. A text
    without claims is unknown with 0.5; one whose claims are all too uncertain is verified with 0.5."""
    c = extracted(texts, key, text, most).withColumn("v", verdict())
    sure = F.col("confidence") >= least
    per = c.groupBy(key).agg(F.count("*").alias("extracted"), F.count_if(sure).alias("claims"), F.count_if(sure & (F.col("v") == "verified")).alias("verified"), F.count_if(sure & (F.col("v") == "falsified")).alias("falsified"))
    out = texts.select(key).join(per, key, "left").fillna(0, ["extracted", "claims", "verified", "falsified"])
    status = F.when(F.col("extracted") == 0, "unknown").when(F.col("falsified") > 0, "falsified").when(F.col("verified") == F.col("claims"), "verified").otherwise("unknown")
    return out.select(key, "claims", "verified", "falsified", status.alias("status"), rounded(F.when(F.col("claims") > 0, F.col("verified") / F.col("claims")).otherwise(F.lit(0.5))).alias("confidence"))


def quickly_judged(texts: DataFrame, key: str = "query_id", text: str = "text", most: int = 10) -> DataFrame:
    """key, claims, confidence, status from the mean confidence of the first most / 2 claims (0.5 without claims)."""
    per = extracted(texts, key, text, most // 2).groupBy(key).agg(F.count("*").alias("claims"), F.avg("confidence").alias("c"))
    out = texts.select(key).join(per, key, "left").withColumn("confidence", rounded(F.coalesce("c", F.lit(0.5))))
    return out.select(key, F.coalesce("claims", F.lit(0)).alias("claims"), "confidence", F.when(F.col("confidence") >= 0.7, "verified").when(F.col("confidence") <= 0.3, "falsified").otherwise("unknown").alias("status"))


def opposite(p: Column, q: Column) -> Column:
    pairs = reduce(lambda x, y: x | y, [((p == a) & (q == b)) | ((p == b) & (q == a)) for a, b in OPPOSITES])
    return pairs | (p == F.concat(F.lit("not "), q)) | (q == F.concat(F.lit("not "), p))


def conflicts(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, second (places of the sentences, first < second), kind of claims of one text that don't go together:
    contradiction (a claim and its negation, or the same subject and verb, once negated), predicate (opposite verbs or, for one
    verb, different objects), comparison and temporal (opposite or circular), modal (necessary and unlikely), causal (circular).
    Of several kinds the first counts. Only claims of one text about the same names are ever joined; see `disputes` for the collection."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    c = claims.select(F.col(key), "pos", "kind", "negated", *[low(x).alias(x) for x in ("left", "operator", "right", "object")])
    # what two claims must share: an unordered pair of names, or the subject
    names = F.array_join(F.array_sort(F.array("left", "right")), "\x00")
    inner = F.concat_ws("\x00", "left", "right", "object")
    c = c.withColumn("on", F.when(F.col("kind") == "predicate", F.col("left")).when(F.col("kind") == "modal", inner).otherwise(names))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.on") == F.col("b.on")) & (F.col("a.pos") < F.col("b.pos")))
    A, B = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    equal = reduce(lambda x, y: x & y, [A(x) == B(x) for x in ("left", "operator", "right", "object")])
    plain, differ = ~A("negated") & ~B("negated"), A("negated") != B("negated")
    straight, crossed = (A("left") == B("left")) & (A("right") == B("right")), (A("left") == B("right")) & (A("right") == B("left"))
    either = lambda x, y: ((A("operator") == x) & (B("operator") == y)) | ((A("operator") == y) & (B("operator") == x))
    kind = lambda k: A("kind") == k
    found = (
        F.when(differ & equal, "contradiction")
        .when(kind("predicate") & differ & (A("operator") == B("operator")), "contradiction")
        .when(kind("predicate") & plain & (opposite(A("operator"), B("operator")) | ((A("operator") == B("operator")) & (A("object") != "") & (B("object") != "") & (A("object") != B("object")))), "predicate")
        .when(kind("comparison") & plain & ((straight & either("<", ">")) | (crossed & (A("operator") == B("operator")) & A("operator").isin("<", ">"))), "comparison")
        .when(kind("temporal") & plain & ((straight & either("before", "after")) | (crossed & (A("operator") == B("operator")) & A("operator").isin("before", "after"))), "temporal")
        .when(kind("modal") & plain & either("necessarily", "unlikely"), "modal")
        .when(kind("causal") & plain & crossed & (A("left") != A("right")), "causal")
    )
    return j.select(F.col(f"a.{key}").alias(key), A("pos").alias("first"), B("pos").alias("second"), found.alias("kind")).filter("kind is not null")


#: The excluding predicates of each predicate.
_AGAINST = {p: sorted({b for a, b in OPPOSITES if a == p} | {a for a, b in OPPOSITES if b == p}) for pair in OPPOSITES for p in pair}
#: Structures of a dispute that one task pairs with all others.
PIECE = 1000


def _sided(claims: DataFrame, key: str) -> DataFrame:
    """A row for each conflict a claim may be part of: conflict, about (what both sides share), side; with the claim's key, pos,
    structure (64-bit fingerprint of its normalized parts), those parts, confidence and specificity."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c)
    c = claims.select(key, "pos", "kind", "negated", "confidence", specificity().alias("specificity"), *[low(x) for x in ("left", "operator", "right", "object")])
    c = c.withColumn("structure", F.xxhash64("kind", "left", "operator", "right", "object", "negated"))
    of = lambda conflict, about, side, when: F.when(when, F.struct(F.lit(conflict).alias("conflict"), F.array(*about).alias("about"), side.cast("string").alias("side")))
    kind, verb, plain = F.col("kind"), F.col("operator"), ~F.col("negated")
    predicate, names = kind == "predicate", (F.least("left", "right"), F.greatest("left", "right"))
    opposites = F.coalesce(F.element_at(F.create_map(*[x for p, qs in _AGAINST.items() for x in (F.lit(p), literals(qs))]), verb), F.array().cast("array<string>"))
    opposites = F.array_distinct(F.concat(opposites, F.array(F.concat(F.lit("not "), verb)), F.when(F.startswith(verb, F.lit("not ")), F.array(F.substring(verb, F.lit(5), F.length(verb)))).otherwise(F.array().cast("array<string>"))))
    opposed = F.transform(opposites, lambda q: F.struct(F.lit("predicate").alias("conflict"), F.array(F.lit("verbs"), F.col("left"), F.least(verb, q), F.greatest(verb, q)).alias("about"), verb.alias("side")))
    sides = [
        of("contradiction", (kind, "left", verb), F.col("negated"), predicate),
        of("contradiction", (kind, "left", verb, "right", "object"), F.col("negated"), ~predicate),
        of("predicate", (F.lit("objects"), "left", verb), F.col("object"), predicate & plain & (F.col("object") != "")),
        of("modal", ("left", "right", "object"), verb, (kind == "modal") & plain & verb.isin("necessarily", "unlikely")),
        of("causal", names, F.col("left"), (kind == "causal") & plain & (F.col("left") != F.col("right"))),
    ]
    for name, operators in (("comparison", ("<", ">")), ("temporal", ("before", "after"))):
        this = (kind == name) & plain & verb.isin(*operators)
        sides += [of(name, (F.lit("straight"), "left", "right"), verb, this), of(name, (F.lit("crossed"), verb, *names), F.col("left"), this)]
    every = F.concat(F.array_compact(F.array(*sides)), F.when(predicate & plain, opposed).otherwise(F.array().cast("array<struct<conflict:string,about:array<string>,side:string>>")))
    return c.select("*", F.inline(every))


def _contested_groups(sided: DataFrame) -> DataFrame:
    return sided.groupBy("conflict", "about").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.count("*").alias("n")).filter("a <> b").select("conflict", "about", "n")


def disputes(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """conflict, about, side, structure, its parts, key, pos, confidence: what the whole collection's claims, of one text or of
    different ones, don't agree on. Any two structures of one (conflict, about) with different sides are in conflict, by the rules of
    `conflicts`, and any two in conflict share exactly one (conflict, about): no pairs are formed, so a hot subject has as many
    rows as claims. Claims of equal structure (in lower case and trimmed) never conflict."""
    sided = _sided(cut(claims), key)
    groups = cut(_contested_groups(sided)).drop("n")
    return sided.join(small(groups), ["conflict", "about"], "left_semi").select("conflict", "about", "side", "structure", "kind", "left", "operator", "right", "object", "negated", key, "pos", "confidence")


def structure_conflicts(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """first, second (structures as in `disputes`, by the first key and place they occur at), kind, and the sides' confidence (mean of
    the claims) and specificity: every pair of structures of the collection in conflict, once. Copies are one structure. The
    structures of a large dispute are dealt to several tasks."""
    by = ["conflict", "about", "side", "structure"]
    s = _sided(claims, key).groupBy(*by).agg(rounded(F.avg("confidence")).alias("c"), F.max("specificity").alias("s"), F.min(F.struct(key, "pos", "structure")).alias("at"))
    s = cut(s)
    groups = cut(_contested_groups(s)).withColumn("pieces", F.floor(F.col("n") / PIECE).cast("int") + 1).drop("n")
    s = s.join(small(groups), ["conflict", "about"]).withColumn("about", F.xxhash64("conflict", "about"))
    a = s.select("conflict", "about", F.pmod("structure", "pieces").cast("int").alias("piece"), *[F.col(x).alias(f"a_{x}") for x in ("side", "structure", "c", "s", "at")])
    b = s.select("conflict", "about", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), *[F.col(x).alias(f"b_{x}") for x in ("side", "structure", "c", "s", "at")])
    j = a.join(b, ["conflict", "about", "piece"]).filter("a_side <> b_side and a_at < b_at")
    return j.select(F.col("a_structure").alias("first"), F.col("b_structure").alias("second"), F.col("conflict").alias("kind"), *[F.col(f"{x}_{y}").alias(f"{y}_{z}") for x, z in (("a", "first"), ("b", "second")) for y in ("c", "s")])


def structure_resolutions(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """first, second, kind, action, target (a structure): `resolutions` of every pair of structure_conflicts."""
    return structure_conflicts(claims, key).select("first", "second", "kind", F.inline(_actions("long")))


def specificity() -> Column:
    """How much a claim says: 3 for predicates, comparisons and orders, one more for a negation; a modal one more than its inside."""
    base = F.when(F.col("kind") == "implies", 2).when(F.col("kind") == "causal", 3).when(F.col("kind") == "modal", F.when(F.col("right").isNull(), 2).otherwise(4)).otherwise(3)
    return base + F.col("negated").cast("int")


def resolutions(found: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, second, action, target (the place of the claim to act on): prioritize (drop the less sure by more than 0.1), remove the less
    specific, add_exception for predicate and temporal conflicts, modify the second claim of a predicate conflict."""
    side = lambda s: claims.select(F.col(key), F.col("pos").alias(s), F.col("confidence").alias(f"c_{s}"), specificity().alias(f"s_{s}"))
    j = found.join(side("first"), [key, "first"]).join(side("second"), [key, "second"])
    return j.select(key, "first", "second", F.inline(_actions("int")))


def _actions(target_type: str) -> Column:
    """What can be done about a conflict (kind, first, second with c_ and s_, the sides' confidence and specificity)."""
    act = lambda name, when, target: F.when(when, F.struct(F.lit(name).alias("action"), target.cast(target_type).alias("target")))
    gap = F.col("c_first") - F.col("c_second")
    return F.array_compact(F.array(
        act("prioritize", F.abs(gap) > 0.1, F.when(gap > 0, F.col("second")).otherwise(F.col("first"))),
        act("remove", F.col("s_first") != F.col("s_second"), F.when(F.col("s_first") < F.col("s_second"), F.col("first")).otherwise(F.col("second"))),
        act("add_exception", F.col("kind").isin("temporal", "predicate"), F.col("first")),
        act("modify", F.col("kind") == "predicate", F.col("second")),
    ))


def contested(claims: DataFrame) -> DataFrame:
    """subject, verb, objects (different ones), claims: what the collection says differently about one subject, without forming pairs."""
    p = claims.filter("kind = 'predicate' and not negated and object != ''")
    return p.groupBy(F.col("left").alias("subject"), F.col("operator").alias("verb")).agg(F.count_distinct("object").alias("objects"), F.count("*").alias("claims")).filter("objects > 1")


# Words that make a claim of a pattern's kind, wherever they stand in a sentence.
PATTERNS = {"predicate": ["is", "are", "was", "were"], "comparison": ["greater", "less", "more", "fewer", "equal"], "conditional": ["if", "when", "then"]}


def patterned(texts: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """key, pos, place, sentence, kind, operator (the first of the kind's words that the sentence contains, even inside a word), confidence 0.6:
    a claim for each kind of PATTERNS, whose subject or raw text is the sentence; of a text the first `most`."""
    s = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(sentences(text)).alias("pos", "sentence"))
    kinds = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.get(F.filter(literals(ws), lambda w: F.contains(F.lower("sentence"), w)), F.lit(0)).alias("operator")) for i, (k, ws) in enumerate(PATTERNS.items())])
    rows = s.select(key, "pos", "sentence", F.inline(F.filter(kinds, lambda x: x["operator"].isNotNull()))).withColumn("confidence", F.lit(0.6))
    if most is not None:
        from .ranking import first_rows

        rows = first_rows(rows, [key], ["pos", "place"], most, "_n").drop("_n")
    return rows


def grouped(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per claim structure of the collection (parts in lower case, trimmed): n, texts, first (the least (key, pos))."""
    whole = [F.coalesce(F.lower(F.trim(p)), F.lit("")).alias(p) for p in PARTS if p != "negated"]
    return claims.select(key, "pos", "negated", *whole).groupBy(*PARTS).agg(F.count("*").alias("n"), F.count_distinct(key).alias("texts"), F.min(F.struct(key, "pos")).alias("first"))


def consistent(texts: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, claims, contested (structures of its own that another of its own contradicts), consistent: whether each text's claims can hold
    together. Claims are put to sides as in `disputes`, within each text: no pairs are formed."""
    sided = _sided(claims, key)
    groups = sided.groupBy(key, "conflict", "about").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a <> b").select(key, "conflict", "about")
    against = sided.join(groups, [key, "conflict", "about"], "left_semi").groupBy(key).agg(F.count_distinct("structure").alias("contested"))
    n = claims.groupBy(key).agg(F.count("*").alias("claims"))
    out = texts.select(key).join(n, key, "left").join(against, key, "left").fillna(0, ["claims", "contested"])
    return out.withColumn("consistent", F.col("contested") == 0)


# What is said of a result by status.
STATUS = {
    "verified": ("VERIFIED: All claims in the response have been logically verified.", "✓ Verified"),
    "falsified": ("FALSIFIED: One or more claims in the response are logically inconsistent or contradicted by the evidence.", "✗ Falsified"),
    "unknown": ("UNKNOWN: The verification could not definitively confirm or deny all claims.", "? Unknown"),
}


def _share(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", (x * 100).cast("double"))


def summary(status: Column, claims: Column, verified: Column, falsified: Column, confidence: Column) -> Column:
    """One sentence about a judged text."""
    sure = _share(confidence, 0)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(status == "verified", text("All ", claims, " claims verified successfully with ", sure, " confidence."))
        .when(status == "falsified", text(falsified, " of ", claims, " claims falsified. Only ", verified, " claims verified. Confidence: ", sure))
        .otherwise(text("Verification inconclusive. ", verified, " of ", claims, " claims verified. Confidence: ", sure))
    )


def described() -> Column:
    """A claim's structure for readers."""
    join = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("kind")
    of = lambda name: F.concat(F.lit(f"{name} ("), "operator", F.lit(")"))
    plain = (
        F.when(kind == "predicate", join("Predicate:", F.col("left"), F.col("operator"), F.when(F.col("object") != "", F.col("object"))))
        .when(kind == "comparison", join("Comparison:", F.col("left"), F.col("operator"), F.col("right")))
        .when(kind == "temporal", join("Temporal:", F.col("left"), F.col("operator"), F.col("right")))
        .when(kind == "causal", of("Causal"))
        .when(kind == "modal", of("Modal"))
        .otherwise("Implication")
    )
    return F.when(F.col("negated"), "Negation").otherwise(plain)


def counterexample() -> Column:
    """Why a falsified claim can't hold; null for kinds that say nothing about it."""
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = F.concat_ws(" ", "left", "operator", "right")
    return (
        F.when(F.col("negated"), F.lit(None).cast("string"))
        .when(F.col("kind") == "comparison", join("The comparison '", said, "' cannot be satisfied with the given constraints."))
        .when(F.col("kind") == "temporal", join("The temporal relationship '", said, "' is contradicted by the context."))
        .when(F.col("kind") == "implies", "The implication is falsified because the premise is true but the conclusion is false.")
        .when(F.col("kind") == "causal", "The causal relationship is not supported by the evidence.")
    )


def explained(texts: DataFrame, key: str = "doc_id", text: str = "text", most: int = 10, detailed: int = 5) -> DataFrame:
    """key, summary, explanation of every text as judged: its status, the shares of its claims by verdict, and its first `detailed` claims. A
    text's claims, at most `most`, are put together in one row."""
    j = judged(texts, key, text, most)
    c = extracted(texts, key, text, most).filter(F.col("confidence") >= 0.5).withColumn("v", verdict())
    label = F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v[1])]), F.col("v"))
    why = F.when(F.col("v") == "falsified", counterexample())
    detail = F.concat(F.lit('**Text:** "'), "sentence", F.lit('"\n**Structure:** '), described(), F.lit("\n**Status:** "), label, F.coalesce(F.concat(F.lit("\n**Explanation:** "), why), F.lit("")))
    per = c.select(key, "pos", detail.alias("d")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]).alias("ds"))
    out = j.join(per, key, "left").withColumn("ds", F.coalesce("ds", F.array().cast("array<string>")))
    line = lambda name, n: F.concat(F.lit(f"- {name}: "), n.cast("string"), F.lit("/"), F.col("claims").cast("string"), F.lit(" ("), _share(n / F.col("claims"), 1), F.lit(")"))
    counts = F.concat_ws("\n", line("Verified", F.col("verified")), line("Falsified", F.col("falsified")), line("Unknown", F.col("claims") - F.col("verified") - F.col("falsified")))
    sure = F.concat(F.lit("## Confidence Analysis\nOverall confidence: "), _share(F.col("confidence"), 1), F.lit("\n"), F.when(F.col("claims") > 0, counts).otherwise("No claims were extracted for verification."))
    numbered = F.transform(F.slice("ds", F.lit(1), F.lit(detailed)), lambda d, i: F.concat(F.lit("\n### Claim "), (i + 1).cast("string"), F.lit("\n"), d))
    more = F.when(F.size("ds") > detailed, F.concat(F.lit("\n... and "), (F.size("ds") - detailed).cast("string"), F.lit(" more claims not shown."))).otherwise("")
    details = F.when(F.size("ds") > 0, F.concat(F.lit("\n\n## Claim Details\n"), F.array_join(numbered, ""), more)).otherwise("")
    status = F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v[0])]), F.col("status"))
    whole = F.concat(F.lit("## Verification Status\n"), status, F.lit("\n\n"), sure, details)
    return out.select(key, summary(F.col("status"), F.col("claims"), F.col("verified"), F.col("falsified"), F.col("confidence")).alias("summary"), whole.alias("explanation"))
