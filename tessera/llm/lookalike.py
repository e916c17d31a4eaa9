"""Problem 9: one form for texts that look the same."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, spread

# Scripts whose letters are looked up in Unicode's table of confusable characters, as ranges of code points.
SCRIPTS = {"Greek": [(0x370, 0x3FF)], "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)], "Armenian": [(0x530, 0x58F)], "Cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)], "Coptic": [(0x2C80, 0x2CFF)]}
# Letters of other scripts and the Latin letters that look the same, which hold before that table.
SAME_LOOK = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ρ": "p",
    # Armenian
    "Օ": "O", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g",
}
#: Code points that Unicode calls default-ignorable (invisible where they aren't supported), as ranges.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS and the Latin letters of their case that look the same: those with one skeleton in Unicode's table of
    confusable characters, as the ICU library has it that Spark comes with; and SAME_LOOK, which also holds where ICU is absent."""
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
        latin = {(skeleton(c), c.islower()): c for c in string.ascii_letters}
        known = {c: latin.get((skeleton(c), c.islower())) for ranges in SCRIPTS.values() for a, b in ranges for c in map(chr, range(a, b + 1)) if c.isalpha()}
    except TypeError:  # no such class
        known = {}
    return {c: x for c, x in known.items() if x} | SAME_LOOK


@lru_cache(8)
def _table(letters: frozenset) -> dict[int, str | None]:
    table: dict[int, str | None] = {c: None for a, b in IGNORABLE for c in range(a, b + 1)}
    table |= {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Zs"} | {0x09: " "}
    return table | {ord(k): v for k, v in letters}


class Canonical:
    """Brings texts into one form, each distinct stretch between blanks and line breaks once: no character joins with one beyond them.
    What is remembered is bounded."""

    def __init__(self, letters: dict[str, str] = SAME_LOOK, fold: bool = True, limit: int = 300_000):
        self.table, self.fold, self.limit, self.known = _table(frozenset(letters.items())), fold, limit, {}

    def _stretch(self, x: str) -> str:
        if (y := self.known.get(x)) is None:
            # apart first, so that accents on a look-alike letter meet the same letter; invisible characters can part them
            y = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", x.translate(self.table)).translate(self.table))
            if self.fold:
                y = unicodedata.normalize("NFKC", y.casefold())
            if len(x) <= 64:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[x] = y
        return y

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            text = text.replace("\t", " ") if "\t" in text else text
            return text.lower() if self.fold else text
        return "\n".join(" ".join(map(self._stretch, line.split(" "))) for line in text.split("\n"))


@lru_cache(4)
def _plain(fold: bool) -> Canonical:
    return Canonical(fold=fold)


def canonical(text: str | None, fold: bool = True) -> str | None:
    """Compatibility-composed form (NFKC) without default-ignorable characters, all blanks as U+0020 and look-alike letters
    as Latin ones; with `fold` also full case folding. Null stays null. Idempotent. Line breaks stay as they are."""
    return _plain(fold)(text)


def _each_once(values: list, f) -> list:
    """f of each distinct value of a batch, laid out again for all."""
    known: dict = {}
    return [known[v] if v in known else known.setdefault(v, f(v)) for v in values]


def with_canonical(df: DataFrame, text: str = "text", to: str = "canonical", fold: bool = True) -> DataFrame:
    """All columns of df and the canonical text under the name `to` (which replaces a column of that name)."""
    rest = [c for c in df.columns if c != to]
    schema = df.select(*[f"`{c}`" for c in rest]).schema.add(to, "string")
    at, letters = rest.index(text), confusables(df.sparkSession)

    def run(batches):
        form = Canonical(letters, fold)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_each_once(b.column(at).to_pylist(), form), pa.string())], [*rest, to])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def _longs(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = False) -> DataFrame:
    """key, form (128-bit hash of the canonical text), stored (128-bit hash of the text as it is) of every non-empty text.
    Only hashes leave the task that reads a text."""

    letters = confusables(df.sparkSession)

    def run(batches):
        form = Canonical(letters, fold)
        for b in batches:
            keys, texts = (x.to_pylist() for x in b.columns)
            made = _each_once(texts, lambda t: (*_longs(form(t)), *_longs(t)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *(pa.array([x[i] for x in made], pa.int64()) for i in range(4))], [key, "f1", "f2", "s1", "s2"])

    kind = df.schema[key].dataType.simpleString()
    some = spread(df.select(key, text)).filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    hashed = some.mapInArrow(run, f"`{key}` {kind}, f1 long, f2 long, s1 long, s2 long")
    return hashed.select(key, F.struct("f1", "f2").alias("form"), F.struct("s1", "s2").alias("stored"))


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of keys (key_a < key_b) whose texts differ as stored but share their canonical form (case counts). Pairs are
    made between different texts of a form; equal texts only share the links of their text. Null and empty texts, null
    keys and an empty table give no pairs."""
    rows = cut(look_alike_classes(df, key, text))
    texts = rows.select("form", "stored").distinct()
    mixed = texts.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    texts = texts.join(mixed, "form", "left_semi")
    links = texts.join(texts.select("form", F.col("stored").alias("other")), "form").filter("stored != other").select("stored", "other")
    a = rows.select(F.col(key).alias(f"{key}_a"), "stored")
    b = rows.select(F.col(key).alias(f"{key}_b"), F.col("stored").alias("other"))
    pairs = links.join(a, "stored").join(b, "other").filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return pairs.select(f"{key}_a", f"{key}_b").distinct()


def look_alike_members(df: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = False) -> DataFrame:
    """One row per key and text: key, representative (the least key of its class of equal forms), texts (different stored texts in the
    class), copies (rows that store the very same text). Null and empty texts and null keys have no row."""
    rows = cut(look_alike_classes(df, key, text, fold))
    texts = rows.groupBy("form", "stored").agg(F.count("*").alias("copies"), F.min(key).alias("least"))
    classes = texts.groupBy("form").agg(F.count("*").alias("texts"), F.min("least").alias("representative"))
    return rows.join(texts.drop("least"), ["form", "stored"]).join(classes, "form").select(key, "representative", "texts", "copies")
