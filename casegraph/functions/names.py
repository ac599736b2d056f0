"""Names: transliteration, normalisation, phonetic keys, similarity. Built-in functions only: what Spark lacks are folds over letters."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the two scripts with the Latin spelling of each consonant (with its inherent a) and vowel sign.
KANNADA = {
    "consonants": {
        "ಕ": "ka", "ಖ": "kha", "ಗ": "ga", "ಘ": "gha", "ಙ": "nga", "ಚ": "ca", "ಛ": "cha", "ಜ": "ja", "ಝ": "jha", "ಞ": "nya",
        "ಟ": "ta", "ಠ": "tha", "ಡ": "da", "ಢ": "dha", "ಣ": "na", "ತ": "ta", "ಥ": "tha", "ದ": "da", "ಧ": "dha", "ನ": "na",
        "ಪ": "pa", "ಫ": "pha", "ಬ": "ba", "ಭ": "bha", "ಮ": "ma", "ಯ": "ya", "ರ": "ra", "ಱ": "ra", "ಲ": "la", "ವ": "va",
        "ಶ": "sha", "ಷ": "sha", "ಸ": "sa", "ಹ": "ha", "ಳ": "la",
    },
    "signs": {"ಾ": "a", "ಿ": "i", "ೀ": "i", "ು": "u", "ೂ": "u", "ೃ": "ru", "ೆ": "e", "ೇ": "e", "ೈ": "ai", "ೊ": "o", "ೋ": "o", "ೌ": "au"},
    "halant": "್", "anusvara": "ಂ", "visarga": "ಃ",
}
DEVANAGARI = {
    "consonants": {
        "क": "ka", "ख": "kha", "ग": "ga", "घ": "gha", "ङ": "nga", "च": "ca", "छ": "cha", "ज": "ja", "झ": "jha", "ञ": "nya",
        "ट": "ta", "ठ": "tha", "ड": "da", "ढ": "dha", "ण": "na", "त": "ta", "थ": "tha", "द": "da", "ध": "dha", "न": "na",
        "प": "pa", "फ": "pha", "ब": "ba", "भ": "bha", "म": "ma", "य": "ya", "र": "ra", "ल": "la", "व": "va",
        "श": "sha", "ष": "sha", "स": "sa", "ह": "ha", "ळ": "la",
    },
    "signs": {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ru", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"},
    "halant": "्", "anusvara": "ं", "visarga": "ः",
}
# Titles before and suffixes after a name.
SALUTATIONS = "sri|shri|smt|srimati|mr|mrs|dr|late"
SUFFIXES = "kumar|bai|devi|amma|gowda|swamy|reddy"
# Soundex codes; metaphone digraphs and single letters.
SOUNDEX = ("BFPVCGJKQSXZDTLMNR", "111122222222334556")
DIGRAPHS = {"SH": "x", "TH": "t", "KH": "k", "GH": "k", "CH": "x", "PH": "f"}
METAPHONE = ("BCDFGJKLMNPQRSTVWXZ", "BXJFKJKLMNPQRSTFFXS")

INDIC = "[\\u0900-\\u097F\\u0C80-\\u0CFF]"


# Vowel signs written in parts, with the sign that the parts make up, longer ones first.
PARTS = [("\u0cc6\u0cc2\u0cd5", "\u0ccb"), ("\u0cca\u0cd5", "\u0ccb"), ("\u0cc6\u0cc2", "\u0cca"), ("\u0cc6\u0cd5", "\u0cc7"), ("\u0cc6\u0cd6", "\u0cc8"), ("\u0cbf\u0cd5", "\u0cc0")]
#: A Latin letter and a mark that Unicode writes as one letter, outside a to z.
_MARKS = [chr(c) for c in range(0x300, 0x370)]
_MARKED = "|".join(f"{x}(?=[\u0300-\u036f]*[{''.join(m)}])" for x in string.ascii_letters if (m := [k for k in _MARKS if len(unicodedata.normalize("NFC", x + k)) == 1]))


def _letters() -> list[tuple[str, str, str, str]]:
    """(letter, script, kind, spelling): kinds c consonant, v vowel sign, h halant, m anusvara, b visarga."""
    out = []
    for name, script in (("K", KANNADA), ("D", DEVANAGARI)):
        out += [(x, name, "c", latin) for x, latin in script["consonants"].items()] + [(x, name, "v", latin) for x, latin in script["signs"].items()]
        out += [(script["halant"], name, "h", ""), (script["anusvara"], name, "m", "m"), (script["visarga"], name, "b", "h")]
    return out


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def transliterate(text: Column) -> Column:
    """Latin spelling of Kannada and Devanagari letters; a word's last inherent a goes. Text without such letters stays as it is,
    but for Latin letters with a combining mark, which go, as they are no letters from a to z.

    A fold over the letters keeps what is spelt so far and the script of a consonant whose inherent a may still go."""
    every = _letters()
    alphabet = F.lit("".join(x[0] for x in every))
    column = lambda i: F.array(*(F.lit(x[i]) for x in every))
    whole = F.regexp_replace(text, _MARKED, "")
    for parts, sign in PARTS:
        whole = F.replace(whole, F.lit(parts), F.lit(sign))

    def step(acc: Column, x: Column) -> Column:
        def known(at: Column) -> Column:
            script, kind, latin = (F.get(column(i), at - 1) for i in (1, 2, 3))
            bare = F.substring(acc["out"], F.lit(1), F.length(acc["out"]) - 1)  # without the inherent a
            kept = F.when(kind.isin("h", "v") & (acc["open"] == script), bare).otherwise(acc["out"])
            # Kannada is spelt first, so a Kannada halant of no consonant is gone by when Devanagari is
            still = (kind == "h") & (script == "K") & (acc["open"] == "D")
            spelt = F.struct(F.concat(kept, latin).alias("out"), F.when(kind == "c", script).when(still, "D").otherwise("").alias("open"))
            return F.when(at > 0, spelt).otherwise(F.struct(F.concat(acc["out"], x).alias("out"), F.lit("").alias("open")))

        return let(F.instr(alphabet, x), known)

    spelt = F.aggregate(F.split(whole, ""), F.struct(F.lit("").alias("out"), F.lit("").alias("open")), step, lambda acc: acc["out"])
    return F.when(text.rlike(INDIC), F.regexp_replace(spelt, r"(?i)([bcdfghjklmnpqrstvwxyz])a(?=\s|$)", "$1")).otherwise(whole)


def normalise_latin(raw: Column) -> Column:
    """Lower case, without one title, without one suffix if two words remain, letters and single spaces only."""
    low = F.regexp_replace(F.lower(raw), rf"^({SALUTATIONS})\s+", "")
    # a suffix goes only after two other words; one pattern, so that the name stands in the expression once
    short = F.regexp_replace(low, rf"(?s)^(\s*\S+\s+.*\S)\s+({SUFFIXES})$", "$1")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(short, r"[^a-z\s]", ""), r"\s+", " ")), F.lit(""))


def normalise_name(raw: Column) -> Column:
    """As ``normalise_latin`` after transliteration."""
    return normalise_latin(transliterate(raw))


def soundex_token(token: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y go before coding, so equal codes around them fall together."""
    u = F.upper(token)
    first = F.substring(u, 1, 1)
    lead = F.regexp_replace(F.translate(first, *SOUNDEX), "[^0-9]", "")
    codes = F.regexp_replace(F.translate(F.regexp_replace(F.substring(u, 2, 1000), "[AEIOUHWY]", ""), *SOUNDEX), "[^0-9]", "")
    runs = F.regexp_replace(F.concat(lead, codes), r"(\d)\1+", "$1")
    rest = F.when(F.length(lead) > 0, F.substring(runs, 2, 1000)).otherwise(runs)
    return F.when(F.length(token) > 0, F.rpad(F.concat(first, rest), 4, "0")).otherwise("")


def metaphone_token(token: Column) -> Column:
    x = F.upper(token)
    for two, mark in DIGRAPHS.items():
        x = F.replace(x, F.lit(two), F.lit(mark))
    x = F.translate(F.regexp_replace(x, "[AEIOUYH]", ""), *METAPHONE)
    again = "|".join(f"(?<=[{c}{c.lower()}]){c}" for c in sorted(set(METAPHONE[1])))
    return F.upper(F.regexp_replace(F.regexp_replace(x, again, ""), "[^A-Za-z]", ""))


def by_token(name: Column, fn) -> Column:
    """A function of each word, joined by spaces."""
    return F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda t: F.length(t) > 0), fn), " ")


def soundex_name(name: Column) -> Column:
    return by_token(name, soundex_token)


def metaphone_name(name: Column) -> Column:
    return by_token(name, metaphone_token)


def phonetic_key(name: Column) -> Column:
    """Soundex and metaphone of the first word; empty for an empty name."""
    first = F.array(F.split(F.trim(name), r"\s+")[0])  # bound to a variable, so that the word is cut out once
    return F.when(F.length(F.trim(name)) > 0, F.transform(first, lambda t: F.concat_ws(" ", soundex_token(t), metaphone_token(t)))[0]).otherwise("")


def last_word_key(name: Column) -> Column:
    """Soundex and metaphone of the last word."""
    last = F.array(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    return F.when(F.length(F.trim(name)) > 0, F.transform(last, lambda t: F.concat_ws(" ", soundex_token(t), metaphone_token(t)))[0]).otherwise("")


def initial_surname_key(name: Column) -> Column:
    """The first letter and the soundex of the last word; empty for a name of one word."""
    words = F.split(F.trim(name), r"\s+")
    return F.when(F.size(words) > 1, F.transform(F.array(F.element_at(words, -1)), lambda t: F.concat_ws(" ", F.substring(F.trim(name), 1, 1), soundex_token(t)))[0]).otherwise("")


def surname_age_key(name: Column, age: Column, band: int = 5) -> Column:
    """The last word and the age's band of ``band`` years; empty without an age or a second word."""
    words = F.split(F.trim(name), r"\s+")
    return F.when((F.size(words) > 1) & age.isNotNull(), F.concat_ws(" ", F.element_at(words, -1), F.floor(age / band).cast("string"))).otherwise("")


def spelling_variants(name: Column) -> Column:
    """A name's own spelling and those that data entry makes of it: first word's initial, words swapped, a doubled letter dropped, vowels dropped after the first letter."""
    words = F.split(F.trim(name), r"\s+")
    two = F.size(words) > 1
    return F.array_distinct(F.array_compact(F.array(
        F.trim(name), F.when(two, F.concat_ws(" ", F.substring(F.trim(name), 1, 1), F.element_at(words, -1))), F.when(two, F.array_join(F.reverse(words), " ")),
        F.regexp_replace(F.trim(name), r"([a-z])\1", "$1"), F.regexp_replace(F.trim(name), r"(?<=\w)[aeiou]", ""),
    )))


#: Stand for a letter that has been matched and for the space before a name's first letter; names don't hold them.
_USED, _BEFORE = "\u0001", "\u0002"


def _jaro_winkler(a: Column, b: Column) -> Column:
    """Of two different names of two letters or more, or of one letter beside a longer one."""
    longest = F.greatest(F.length(a), F.length(b))
    # ``free`` begins with as many spaces as a window reaches back, so letter i of a looks at what begins at i
    start = F.struct(a.alias("a"), b.alias("b"), F.shiftright(longest, 1).alias("half"), F.length(a).cast("double").alias("la"), F.length(b).cast("double").alias("lb"))

    def matched(p: Column) -> Column:
        width = F.struct((p["half"] * 2 - 1).alias("w"), F.concat(F.repeat(F.lit(_BEFORE), p["half"] - 1), p["b"]).alias("free"))

        def fold(v: Column) -> Column:
            def step(acc: Column, e: Column) -> Column:
                found = F.instr(F.substring(acc["free"], e["i"], v["w"]), e["x"])
                return let(found, lambda k: F.when(k > 0, F.struct(F.overlay(acc["free"], F.lit(_USED), e["i"] + k - 1, F.lit(1)).alias("free"), F.concat(acc["met"], e["x"]).alias("met"))).otherwise(acc))

            letters = F.transform(F.split(p["a"], ""), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
            got = F.aggregate(letters, F.struct(v["free"].alias("free"), F.lit("").alias("met")), step)
            def result(acc: Column) -> Column:
                in_b = F.array_join(F.zip_with(F.split(acc["free"], ""), F.split(v["free"], ""), lambda f, x: F.when(f == _USED, x).otherwise("")), "")
                return F.when(acc["met"] == "", 0.0).otherwise(let(in_b, lambda other: measured(acc["met"], other)))

            return let(got, result)

        def measured(met: Column, in_b: Column) -> Column:
            other = F.size(F.filter(F.zip_with(F.split(met, ""), F.split(in_b, ""), lambda x, y: x != y), lambda x: x)).cast("double")
            moved = F.when((F.length(met) < 2) | (met == in_b), 0.0).otherwise(other)
            n = F.length(met).cast("double")
            prefix = lambda k: F.left(p["a"], F.lit(k)) == F.left(p["b"], F.lit(k))
            whole = lambda k: (p["la"] >= k) & (p["lb"] >= k) & prefix(k)
            same = F.when(~whole(1), 0).when(whole(4), 4).when(whole(3), 3).when(whole(2), 2).otherwise(1)
            jaro = (n / p["la"] + n / p["lb"] + (n - moved / 2) / n) / 3
            return let(jaro, lambda j: j + same * F.lit(0.1) * (1 - j))

        return let(width, fold)

    return let(start, matched)


def jaro_winkler(a: Column, b: Column) -> Column:
    """With a prefix bonus at any similarity; null counts as empty. Two one-letter words share no window, so even equal ones score 0.

    A fold over the letters of ``a`` takes, for each, the first free equal letter of ``b`` within reach."""
    text = lambda c: F.coalesce(c, F.lit(""))
    of = lambda p: (
        F.when((F.length(p["a"]) == 0) | (F.length(p["b"]) == 0) | (p["a"] == p["b"]) | (F.length(p["a"]) + F.length(p["b"]) == 2), F.when((p["a"] == p["b"]) & (F.length(p["a"]) != 1), 1.0).otherwise(0.0))
        .otherwise(_jaro_winkler(p["a"], p["b"]))
    )
    return let(F.struct(text(a).alias("a"), text(b).alias("b")), of)


def _words(name: Column) -> Column:
    return F.filter(F.split(F.translate(name, "\t\n\v\f\r", "     "), " "), lambda w: w != "")


def name_score(a: Column, b: Column) -> Column:
    """The better of the names as they stand and with sorted words; less if only the last words differ much. Null counts as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    split = F.struct(text(a).alias("a"), text(b).alias("b"), _words(text(a)).alias("wa"), _words(text(b)).alias("wb"))
    with_sorted = lambda p: F.struct(*(p[c].alias(c) for c in ("a", "b", "wa", "wb")), *(F.array_join(F.array_sort(p[w]), " ").alias(n) for w, n in (("wa", "sa"), ("wb", "sb"))))

    def score(p: Column) -> Column:
        as_sorted = (p["a"] == p["sa"]) & (p["b"] == p["sb"])
        base = let(jaro_winkler(p["a"], p["b"]), lambda v: F.when(as_sorted | (v == 1), v).otherwise(F.greatest(v, jaro_winkler(p["sa"], p["sb"]))))
        first, last = (lambda w: F.get(w, F.lit(0))), (lambda w: F.get(w, F.size(w) - 1))
        only_last = (F.size(p["wa"]) > 1) & (F.size(p["wb"]) > 1) & (first(p["wa"]) == first(p["wb"])) & (last(p["wa"]) != last(p["wb"]))
        cut = F.when(only_last, let(jaro_winkler(last(p["wa"]), last(p["wb"])), lambda v: F.when(v < 0.6, 0.65).when(v < 0.8, 0.8).otherwise(1.0))).otherwise(1.0)
        return F.least(base * cut, F.lit(1.0))

    return let(let(split, with_sorted), score)


def letter_bag(name: Column) -> Column:
    """A name's letters, each with how often it came before: two names share as many of these as they have letters in common."""
    letters = F.array_sort(F.split(F.coalesce(name, F.lit("")), ""))
    return let(letters, lambda ls: F.transform(ls, lambda x, i: F.concat(x, (i - F.array_position(ls, x)).cast("string"))))


def name_score_bound(a: Column, b: Column, bag_a: Column, bag_b: Column) -> Column:
    """No less than the ``name_score`` of normalised names: letters in common bound the matches, and four letters the prefix."""
    la, lb = F.length(a), F.length(b)
    jaro = lambda m: F.when(m == 0, 0.0).otherwise((m / la + m / lb + 1) / 3)
    bound = lambda m: let(jaro(m), lambda j: F.least(F.lit(1.0), j + 0.4 * (1 - j) + 1e-9))
    return F.when((la == 0) | (lb == 0), 1.0).otherwise(let(F.size(F.array_intersect(bag_a, bag_b)).cast("double"), bound))
