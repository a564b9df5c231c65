"""Text functions, Column to Column; each has its DuckDB form beside it where an oracle needs one."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def latin_table() -> tuple[str, str, dict[str, str]]:
    """Transliteration of Latin, Greek and Cyrillic letters: two strings for 1:1 replacement, and the longer replacements.

    Letters are taken apart by Unicode's own decompositions; letters that have none, and the base letters of
    Greek and Cyrillic, are listed. Other scripts are outside the covered range and removed.
    """
    # fixed values: Greek and Cyrillic base letters in lower case
    base = dict(zip("αβγδεζηικλμνξοπρσςτυωабвгдезиклмнопрстуфыэйіѓќ", "abgdezeiklmnxoprsstuoabvgdeziklmnoprstufyeiigk", strict=True))
    base |= {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ь": "'", "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj", "є": "ie", "ї": "yi", "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh"}
    listed = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "–": "-", "—": "-", "‘": "'", "’": "'", "´": "'", "“": '"', "”": '"', " ": " "}
    longer = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ẞ": "SS", "€": "EUR", "№": "No", "ĳ": "ij", "Ĳ": "IJ", "᠀": " @ "}
    for code in [*range(0xA0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        c = chr(code)
        low = c.lower()
        parts = [low] if low in base else [x for x in unicodedata.normalize("NFKD", low) if ord(x) < 128 or x in base]
        plain = "".join(base.get(x, x) for x in parts)
        if c in listed or c in longer or len(parts) != 1 or not (parts[0] in base or plain.isalpha()):
            continue
        plain = plain.capitalize() if c != low else plain
        if len(plain) == 1:
            listed[c] = plain
        else:
            longer[c] = plain
    return "".join(listed), "".join(listed.values()), longer


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once: expressions inside higher-order functions are not shared by the optimizer."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def transliterate(x: Column) -> Column:
    """ASCII form of Latin, Greek and Cyrillic text, then @ as a and a backtick as an apostrophe. Text that is ASCII already passes by the tables."""
    one, to, longer = latin_table()
    plain = F.octet_length(x) == F.length(x)
    y = F.translate(x, one, to)
    # most text needs none of the longer replacements: they are tried where one of their letters stands
    full = y
    for a, b in longer.items():
        full = F.replace(full, F.lit(a), F.lit(b))
    y = F.when(F.regexp_like(y, F.lit("[" + "".join(longer) + "]")), full).otherwise(y)
    return F.translate(F.when(plain, x).otherwise(F.regexp_replace(y, "[^\\x00-\\x7F]", "")), "@`", "a'")


def transliterate_sql(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    one, to, longer = latin_table()
    x = f"translate({x}, {q(one)}, {q(to)})"
    for a, b in longer.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"translate(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'), '@`', 'a''')"


def clean(x: Column) -> Column:
    """Literal backslash-n to newline, no carriage returns, ASCII, upper case."""
    return F.upper(transliterate(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\r"), F.lit(""))))


def clean_sql(x: str) -> str:
    t = f"replace(replace({x}, '\\n', chr(10)), chr(13), '')"
    return f"upper({transliterate_sql(t)})"


def normalize_address(x: Column) -> Column:
    """Cache key: cleaned, runs of all but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(clean(x), "[^A-Z0-9]+", " "))


def normalize_address_sql(x: str) -> str:
    return f"trim(regexp_replace({clean_sql(x)}, '[^A-Z0-9]+', ' ', 'g'))"


def lookup_name(x: Column) -> Column:
    return F.upper(F.trim(transliterate(x)))


def country_code(x: Column) -> Column:
    return F.upper(F.trim(x))


def canonical_town(x: Column) -> Column:
    return normalize_address(x)


def is_nil(x: Column) -> Column:
    from ..schemas import NIL

    return x.isNull() | F.lower(F.trim(x)).isin(*NIL)


def is_true(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "yes", "y"), F.lit(False))


# ---------------------------------------------------------------- aliases

SAINT = r"\b(?:SAINT|ST\.|ST)(?:[^\s\w]|\s)"


def separator_aliases(x: Column) -> Column:
    return F.array_distinct(F.array(x, F.replace(x, F.lit("-"), F.lit(" ")), F.replace(x, F.lit(" "), F.lit("-"))))


def aliases(x: Column) -> Column:
    """The name and, for each writing of Saint, its writings with spaces and hyphens; sorted."""

    def written(name: Column) -> Column:
        saints = F.when(F.regexp_like(name, F.lit(SAINT)), F.array(name, *[F.regexp_replace(name, SAINT, s) for s in ("SAINT-", "ST. ", "ST-")])).otherwise(F.array(name))
        return F.array_sort(F.array_distinct(F.concat(F.array(name), F.flatten(F.transform(saints, separator_aliases)))))

    # bound once: a transliterated name is a large expression, and the driver holds each copy of it in every version of a plan
    return let(x, written)


# ---------------------------------------------------------------- similarity


def trigrams(x: Column) -> Column:
    padded = F.concat(F.lit("  "), x, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(trigrams(a), trigrams(b))), F.size(F.array_union(trigrams(a), trigrams(b)))
    return both / either


def lexical_identity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 0.6 of the edit similarity and 0.4 of the trigrams'."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(0.6 * edit + 0.4 * trigram_jaccard(a, b))


def trigrams_sql(x: str) -> str:
    return f"list_distinct([substring('  ' || {x} || '  ', i, 3) for i in range(1, length({x}) + 3)])"


def trigram_jaccard_sql(a: str, b: str) -> str:
    ta, tb = trigrams_sql(a), trigrams_sql(b)
    return f"(len(list_intersect({ta}, {tb})) / len(list_distinct(list_concat({ta}, {tb}))))"


def lexical_identity_sql(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 0.6 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) + 0.4 * {trigram_jaccard_sql(a, b)} end"


# ---------------------------------------------------------------- places in texts


def at(text: Column, start: Column, size: Column) -> Column:
    """Characters from a place counted from 0."""
    return F.substring(text, start + 1, size)


def inside_word(text: Column, start: Column, stop: Column, matched: Column) -> Column:
    """Whether a word character stands right before or behind the match; one full stop at its end doesn't count as part of it."""
    end = F.when(F.endswith(matched, F.lit(".")), stop - 1).otherwise(stop)
    before = (start > 0) & F.regexp_like(at(text, start - 1, F.lit(1)), F.lit("[A-Za-z0-9_]"))
    behind = (end < F.length(text)) & F.regexp_like(at(text, end, F.lit(1)), F.lit("[A-Za-z0-9_]"))
    return (end <= start) | before | behind


def alone_on_line(text: Column, start: Column, stop: Column) -> Column:
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    behind = F.substring_index(F.substring(text, stop + 1, F.length(text)), "\n", 1)
    return (F.trim(before) == "") & (F.trim(behind) == "")


def newline_discount(matched: Column, dist: Column) -> Column:
    """Newlines inside a match of more than two characters are no edits."""
    inner = F.substring(matched, F.lit(2), F.length(matched) - 2)
    return F.when(F.length(matched) > 2, F.greatest(F.lit(0), dist - (F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit("")))))).otherwise(dist)


def between(text: Column, a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """What stands between two matches; empty if they overlap."""
    left, right = F.when(a_start <= b_start, a_stop).otherwise(b_stop), F.when(a_start <= b_start, b_start).otherwise(a_start)
    return F.when(right > left, at(text, left, right - left)).otherwise(F.lit(""))


def postcode_prepared(x: Column) -> Column:
    """All but A-Z and 0-9 as one space each; places stay."""
    return F.regexp_replace(x, "[^A-Z0-9]", " ")


def ibans(x: Column) -> Column:
    from ..schemas import IBAN

    return F.regexp_extract_all(x, F.lit(IBAN), F.lit(1))


def basic_tokens(x: Column) -> Column:
    """Lower-case words, digits and single signs, for WordPiece."""
    return F.regexp_extract_all(F.lower(transliterate(x)), F.lit(r"([a-z0-9]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])"), F.lit(1))


def without_separators(x: Column) -> Column:
    return F.translate(F.upper(x), "- ", "")
