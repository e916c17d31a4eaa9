"""Text as columns: terms, words, sentences, n-grams, stems. Null texts give null, empty ones empty arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode has it; Java's `\s` lacks some.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits.
ALNUM = r"\p{IsAlphabetic}\p{N}"

# Suffixes, the first that fits is cut off.
SUFFIXES = [
    "ational", "tional", "enci", "anci", "izer", "isation", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "aliti", "iviti", "biliti", "logi", "alli", "entli", "eli", "ousli", "ing", "edly", "ly",
    "ness", "ment", "ence", "ance", "able", "ible", "ant", "ent", "ism", "iti", "ous", "ive", "ize", "ise", "al", "er", "ed", "es", "s",
]
# Endings of word forms.
ENDINGS = ["", "s", "es", "ed", "ing", "er", "est", "ly", "ness", "ment", "tion", "ation"]
# Stop words.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might can this that these those it its they them their we our you your "
    "he she him her his i me my not no yes if then else when where what which who whom how why all any both each few more most other some such only own same so than too very just also now here there"
).split()


#: The shortest beginning of at least three bytes that one of the suffixes ends. It meets the longest suffix first; no
#: suffix comes before a longer one that ends alike, so this is the first that fits.
_STEM = rf"(?s)^((?:[\u0800-\x{{10FFFF}}]|[^\x00-\x7F].|.[^\x00-\x7F]|.{{3}}).*?)(?:{'|'.join(SUFFIXES)})$"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often `use` names it (lambdas share no subexpressions)."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of more than one UTF-8 byte."""
    return F.filter(F.split(F.lower(text), f"[^{ALNUM}]+"), lambda w: F.octet_length(w) > 1)


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def bare_words(text: Column | str) -> Column:
    """White-space separated words, lower-cased, of their letters and digits only."""
    return F.filter(F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, f"[^{ALNUM}]+", ""))), lambda w: w != "")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def sentences(text: Column | str, stops: str = ".!?") -> Column:
    """Non-empty trimmed stretches between the stops."""
    return F.filter(F.transform(F.split(text, f"[{stops}]"), strip), lambda s: s != "")


def char_ngrams(text: Column | str, n: int) -> Column:
    """Distinct windows of n characters; none for shorter texts."""

    def windows(t: Column) -> Column:
        return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return let(column(text), windows)


def array_ngrams(items: Column, n: int) -> Column:
    """Joined windows of n array elements."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def stem(word: Column | str) -> Column:
    """The lower-case word without the first fitting suffix that leaves more than two bytes."""
    return F.regexp_replace(F.lower(word), _STEM, "$1")


def word_forms(stem_: Column) -> Column:
    """The stem with each ending."""
    return F.filter(F.transform(literals(ENDINGS), lambda e: F.concat(stem_, e)), lambda f: f != stem_)


def normalized(text: Column | str, drop_punctuation: bool = False) -> Column:
    """Trimmed, lower case, single blanks; optionally without ASCII punctuation."""
    t = F.lower(strip(text))
    if drop_punctuation:
        t = F.regexp_replace(t, r"[!-/:-@\[-`{-~]+", "")
    return F.array_join(words(t), " ")
