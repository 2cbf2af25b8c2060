"""Names across scripts and spellings: romanisation of Devanagari, comparison keys and their similarities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of Devanagari in ISO 15919.
VOWELS = {"अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "r̥", "ॠ": "r̥̄", "ऌ": "l̥", "ए": "ē", "ऐ": "ai", "ओ": "ō", "औ": "au"}
MATRAS = {"ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "r̥", "ॄ": "r̥̄", "ॢ": "l̥", "े": "ē", "ै": "ai", "ो": "ō", "ौ": "au", "ॅ": "e", "ॉ": "o"}
SIGNS = {"ँ": "ṁ", "ं": "ṁ", "ः": "ḥ"}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "ś",
    "ष": "ṣ", "स": "s", "ह": "h", "ळ": "ḷ",
}
DOTTED = {"क": "q", "ख": "kh", "ग": "ġ", "ज": "z", "ड": "ṛ", "ढ": "ṛh", "फ": "f"}
#: ISO 15919 in ASCII as names are typed, in this order.
FOLDS = (
    ("ṁh", "ngh"), ("r̥̄", "ri"), ("r̥", "ri"), ("l̥", "li"), ("ṛh", "rh"), ("ṭh", "th"), ("ḍh", "dh"), ("ā", "a"), ("ī", "i"), ("ū", "u"), ("ē", "e"), ("ō", "o"), ("ṁ", "n"), ("ḥ", "h"),
    ("ṅ", "n"), ("ñ", "n"), ("ṇ", "n"), ("ṛ", "r"), ("ṭ", "t"), ("ḍ", "d"), ("ś", "sh"), ("ṣ", "sh"), ("c", "ch"), ("q", "k"), ("ġ", "g"), ("z", "z"), ("f", "f"),
)
#: Where an inherent vowel inside a word isn't spoken.
CONSONANT = "[kgṅcjñṭḍṇtdnpbmyrlvśṣshqzḍhṭh]"
SILENT = rf"([aāiīuūēōeo]{CONSONANT}{{1,2}})" + "\u0001" + rf"(?={CONSONANT}{{1,2}}[āīūēō])"

VIRAMA, NUKTA, DANDA, INHERENT = "्", "़", "।", "\u0001"


def romanise(c: Column) -> Column:
    """Devanagari in ISO 15919: an inherent vowel stands after consonants without a vowel sign or virama, and goes where it isn't spoken. ASCII comes in
    lower case, digits of Devanagari as digits, all else as a space; null stays null."""
    for base, composed in zip("कखगजडढफय", map(chr, range(0x958, 0x960)), strict=True):  # letters with a dot, as normal forms decompose them
        c = F.replace(c, F.lit(composed), F.lit(base + NUKTA))
    c = F.regexp_replace(c, f"[नरळ]{NUKTA}|[ऩऱऴ]", " ")  # these have no reading here
    letters = "".join(CONSONANTS)
    c = F.regexp_replace(c, f"([{letters}]{NUKTA}?)(?!{NUKTA}|{VIRAMA}|[{''.join(MATRAS)}])", "$1" + INHERENT)
    for base, roman in DOTTED.items():
        c = F.replace(c, F.lit(base + NUKTA), F.lit(roman))
    c = F.regexp_replace(c, f"[{VIRAMA}{NUKTA}]", "")
    digits = {chr(0x966 + i): str(i) for i in range(10)}
    for sign, roman in (VOWELS | MATRAS | SIGNS | CONSONANTS | digits).items():
        c = F.replace(c, F.lit(sign), F.lit(roman))
    known = "".join(sorted(set("".join((VOWELS | MATRAS | SIGNS | CONSONANTS | DOTTED).values())) - set(map(chr, range(128)))))
    c = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"[^\\x00-\\x7F{known}]", " "), r"\s+", " "))
    c = F.regexp_replace(c, INHERENT + r"(?=\s|$)", "")
    return F.replace(F.regexp_replace(c, SILENT, "$1"), F.lit(INHERENT), F.lit("a"))


def fold(c: Column) -> Column:
    """ISO 15919 in plain ASCII."""
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fuzzy_key(c: Column) -> Column:
    """Comparison key of a name in either script: lower-case ASCII letters and digits, all else as spaces."""
    roman = F.when(c.rlike("[ऀ-ॿ]"), fold(romanise(c))).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(roman), "[^a-z0-9 ]+", " "))


def trigrams(key: Column) -> Column:
    """Distinct trigrams of a key between two spaces and one."""
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, " +"), lambda x: x != "")


def sorted_key(key: Column) -> Column:
    """The key with its words in order."""
    return F.array_join(F.array_sort(tokens(key)), " ")


def skeleton(key: Column) -> Column:
    """The key without vowels and spaces."""
    return F.regexp_replace(key, r"[aeiou\s]", "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)
