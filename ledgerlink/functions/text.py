"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ABBREVIATIONS, BANK_PREFIXES, CURRENCIES, LANGUAGE_WORDS, NUMERIC_PADDING

_ACCENTS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŠŽĄĆĘŁŃŚŹŻ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYYSZACELNSZZ"
_LONG = {"Œ": "OE", "Æ": "AE", "ẞ": "SS", "€": "EUR", "’": "'", "–": "-", "—": "-"}


def deaccent(c: Column) -> Column:
    """Latin letters without accents; other scripts are left for the punctuation step."""
    for a, b in _LONG.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _ACCENTS, _PLAIN)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_bank_prefixes(c: Column) -> Column:
    """Up to five leading bank phrases, tried in order."""
    return F.trim(F.regexp_replace(c, r"^(?:(?:" + "|".join(BANK_PREFIXES) + r")\s*){1,5}", ""))


def expand_abbreviations(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def normalize_label(label: Column) -> Column:
    c = deaccent(F.upper(F.coalesce(label, F.lit(""))))
    c = strip_bank_prefixes(F.trim(c))
    return expand_abbreviations(collapse_spaces(F.regexp_replace(c, r"[^A-Z0-9\s]", " ")))


def normalize_amount(raw: Column) -> Column:
    """1.234,56 and 1,234.56 and 1234,56 and plain numbers; null where none fits."""
    c = F.regexp_replace(F.trim(raw), r"[\s €$£]", "")
    number = (
        F.when(c.rlike(r"^-?\d{1,3}(\.\d{3})+,\d{1,2}$"), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(c.rlike(r"^-?\d{1,3}(,\d{3})+\.\d{1,2}$"), F.replace(c, F.lit(","), F.lit("")))
        .when(c.rlike(r"^-?\d+,\d{1,2}$"), F.replace(c, F.lit(","), F.lit(".")))
        .otherwise(c)
    )
    return number.try_cast("double")


def normalize_iban(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", "")


def normalize_date(raw: Column) -> Column:
    """First valid of DD/MM/YYYY, DD/MM/YY (below 50: 20YY) and ISO."""

    def made(y, m, d):
        return F.try_to_date(F.concat(F.lpad(y, 4, "0"), F.lit("-"), m, F.lit("-"), d), "yyyy-MM-dd")

    day4, day2, iso = r"\b(\d{2})[/\-.](\d{2})[/\-.](\d{4})\b", r"\b(\d{2})[/\-.](\d{2})[/\-.](\d{2})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b"
    part = lambda p, i: F.nullif(F.regexp_extract(raw, p, i), F.lit(""))
    short = part(day2, 3)
    return F.coalesce(
        made(part(day4, 3), part(day4, 2), part(day4, 1)),
        made(F.concat(F.when(short.cast("int") < 50, "20").otherwise("19"), short), part(day2, 2), part(day2, 1)),
        made(part(iso, 1), part(iso, 2), part(iso, 3)),
    )


def normalize_currency(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(F.trim(raw))), F.lit("EUR"))


def detect_language(text: Column) -> Column:
    """Most indicator words contained; the first language of equals, FR where none is."""
    up = F.upper(F.coalesce(text, F.lit("")))
    score = {k: sum((F.contains(up, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in LANGUAGE_WORDS.items()}
    best = F.greatest(*score.values())
    out = F.when(best == 0, "FR")
    for k, s in score.items():
        out = out.when(s == best, k)
    return out


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All character n-grams of the text without white space, n ascending, repeats kept."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    one = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in sizes])


def pad_numeric(ref: Column) -> Column:
    runs = F.regexp_extract_all(F.coalesce(ref, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d") & (F.length(r) < NUMERIC_PADDING), F.lpad(r, NUMERIC_PADDING, "0")).otherwise(r)), "")


def normalize_ref(ref: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(ref, F.lit(""))), "[^A-Z0-9]", "")


def strip_leading_zeros(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0")))


def safe_float(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(default))


def safe_div(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d == 0, F.lit(default)).otherwise(n / d)
