"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that are written in several ways, digits, and the classes of letters that differ only by dots.
LETTERS_FROM, LETTERS_TO = "يىكـ", "ییک"
LATIN_DIGITS, ARABIC_DIGITS, PERSIAN_DIGITS = "0123456789", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
SHAPES = {
    "b": "بپتثنیئيى", "h": "جچحخ", "d": "دذ", "r": "رزژ", "s": "سش", "c": "صض", "t": "طظ", "e": "عغ", "f": "فق",
    "k": "کگك", "a": "اآأإ", "o": "هةۀ", "w": "وؤ", "l": "ل", "m": "م",
}
TERMINALS = ".!?؟:…»\"'"
CLOSING = ".؛:؟!»?;"
#: Stand-in for Persian text in tests and queries: the 26 Latin letters one by one.
LATIN, STAND_IN = "abcdefghijklmnopqrstuvwxyz", "ابچدهفگهیژکلمنوپقرستوضوخیز"

#: The letters of a comparison form, but those that are written in several ways.
FORM_LETTERS = "".join(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)])) + "پچژکگیۀ"

DIALOGUE = "^(?:[-–—ـ]|[\\x{0600}-\\x{06FF}\\x{200c}]+(?: [\\x{0600}-\\x{06FF}\\x{200c}]+){0,2}\\s?(?:[-–—ـ]|:\\s))"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x being computed once however often f has it."""
    return F.transform(F.array(x), f)[0]


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that filters and columns behind it take as it is, instead of computing it again in each."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def stand_in(s: Column) -> Column:
    return F.translate(F.lower(s), LATIN, STAND_IN)


def normalize_letters(s: Column) -> Column:
    return F.translate(s, LETTERS_FROM, LETTERS_TO)


def normalize_text(s: Column) -> Column:
    # a single space is a match less for each word
    return F.trim(F.regexp_replace(normalize_letters(s), "[ \\t\\x{00A0}]{2,}|[\\t\\x{00A0}]", " "))


def persian_digits(s: Column) -> Column:
    """Digits become Persian, but not in a word that has a Latin letter."""
    digits = lambda t: F.translate(t, LATIN_DIGITS + ARABIC_DIGITS, PERSIAN_DIGITS * 2)
    tokens = F.regexp_extract_all(s, F.lit(r"(\s+|\S+)"), F.lit(1))
    mapped = F.transform(tokens, lambda t: F.when(t.rlike("[A-Za-z]"), t).otherwise(digits(t)))
    return F.when(s.rlike("[A-Za-z]"), F.array_join(mapped, "")).otherwise(digits(s))


def space_commas(s: Column) -> Column:
    commas = lambda t: F.regexp_replace(F.regexp_replace(t, "\\s*،[\\s\\x{200c}]*", "، "), "،(?:\\s*،)+", "،")
    s = once(s, lambda t: F.when(t.contains("،"), commas(t)).otherwise(t))
    return F.trim(once(s, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def latin_commas(s: Column) -> Column:
    """A Latin comma after Persian text becomes a Persian one, except between digits."""
    digit = "0-9۰-۹٠-٩"
    swapped = F.regexp_replace(s, f"(?<=[\\x{{0600}}-\\x{{06FF}}\\x{{200c}}»)\\]])(?<![{digit}])\\s*,(?=\\s*(?:[\\x{{0600}}-\\x{{06FF}}«(\\[]|$))", "،")
    return F.regexp_replace(swapped, f"(?<=[۰-۹٠-٩])\\s*,(?=\\s*(?:(?![{digit}])[\\x{{0600}}-\\x{{06FF}}«(\\[]|$))", "،")


def close_marks(s: Column) -> Column:
    s = F.regexp_replace(s, f"[ \\t\\x{{200c}}]+([{CLOSING}])", "$1")
    return once(s, lambda t: F.when(t.contains("«"), F.regexp_replace(t, "«[ \\t\\x{200c}]+", "«")).otherwise(t))


def clean_line(s: Column) -> Column:
    return close_marks(space_commas(normalize_text(s)))


def margin_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "\\p{Nd}|[^\\p{L}\\p{N}]", ""))


def persian_letters(s: Column) -> Column:
    return F.regexp_replace(normalize_letters(s), "[^\\x{0621}-\\x{064A}\\x{067E}-\\x{06D3}]", "")


def comparison_form(s: Column) -> Column:
    """Persian letters only. What is left of the text without them is what is taken out of it, since a class of so many
    letters is slow as a regular expression."""
    s = F.translate(F.regexp_replace(s, "[^\\p{L}]+", ""), "يىك", "ییک")
    return F.call_function("translate", s, F.translate(s, FORM_LETTERS, ""), F.lit(""))


def skeleton(s: Column) -> Column:
    return F.translate(comparison_form(s), "".join(SHAPES.values()), "".join(k * len(v) for k, v in SHAPES.items()))


def deletes(s: Column) -> Column:
    """All distinct strings with one character taken out."""
    n = F.length(s)
    out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(out))


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance, limit + 1 where it is larger."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def numbered_title(s: Column) -> Column:
    """`N sep rest`, or `ا sep rest` for a misread one, as a short numbered title, else null."""
    mark = "[-–—ـ:.)]"
    pattern = f"^\\s*(?:([0-9۰-۹]{{1,2}})\\s*{mark}?|ا\\s*{mark})\\s*"
    number = F.translate(F.regexp_extract(s, pattern, 1), LATIN_DIGITS, PERSIAN_DIGITS)
    rest = F.trim(F.regexp_replace(s, pattern, ""))
    letters = F.regexp_count(rest, F.lit("[\\x{0621}-\\x{064A}\\x{067E}-\\x{06D3}]"))
    ok = s.rlike(pattern) & rest.rlike("^[\\x{0600}-\\x{06FF}]") & (letters >= 3) & (F.size(F.split(rest, "\\s+")) <= 6)
    ok = ok & ~rest.rlike("[0-9۰-۹٠-٩]") & ~rest.rlike("[.!،,:؛]$") & ~number.rlike("^۰+$")
    return F.when(ok, F.concat(F.when(number == "", "۱").otherwise(number), F.lit("- "), rest))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes x0, y0, x1, y1; 0 where the union is empty."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
