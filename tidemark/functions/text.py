"""Normalisers and comparisons of names, emails, phones, companies and headers, as column expressions.

Only what the JVM lacks (Unicode folding, IDNA) is an Arrow UDF, and only texts with non-ASCII characters reach it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and domains with a meaning of their own.
GENERIC_INBOXES = ("admin", "billing", "contact", "hello", "help", "info", "office", "sales", "support", "team")
FREE_DOMAINS = ("gmail.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "outlook.com", "yahoo.com")
COMPANY_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "llp", "ltd", "limited", "plc")
NAME_PREFIXES = ("dr", "miss", "mr", "mrs", "ms", "prof")
NAME_SUFFIXES = ("ii", "iii", "iv", "jr", "phd", "sr")
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "null", "not provided", "-", "--", "tbd", "test")
SPACE = r"[\s   -     　﻿]"


def _fold(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in texts:
        yield pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")) for t in x.to_pylist()], pa.string())


def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in texts:
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())


def _idna(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else t.encode("idna").decode().lower()
        except UnicodeError:
            return None

    for x in texts:
        yield pa.array([one(t) for t in x.to_pylist()], pa.string())


def _only_foreign(text: Column, convert) -> Column:
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, convert(F.when(foreign, text))).otherwise(text)


def fold(text: Column) -> Column:
    """Without accents and compatibility forms."""
    return _only_foreign(text, F.arrow_udf(_fold, "string"))


def nfkc(text: Column) -> Column:
    """With compatibility forms composed."""
    return _only_foreign(text, F.arrow_udf(_nfkc, "string"))


def idna(host: Column) -> Column:
    return _only_foreign(host, F.arrow_udf(_idna, "string"))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends (the built-in trim takes spaces only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def header(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(text)), "[^a-z0-9]+", "_"), "^_|_$", "")


def email(raw: Column, strip_www: bool = False) -> Column:
    """A normal address, or null: ASCII local part, host in IDNA form with a dot, nothing that belongs to a URL."""
    low = F.lower(trimmed(raw))
    good = low.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & low.rlike(r"^[\x21-\x7E]+@") & ~low.rlike(r"@.*[:/?#\\]")
    host = idna(F.substring_index(low, "@", -1))
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    return F.when(good, F.concat(F.substring_index(low, "@", 1), F.lit("@"), host))


def email_alias(address: Column) -> Column:
    """Gmail addresses without dots and plus parts; others unchanged."""
    local, host = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    return F.when(host.isin("gmail.com", "googlemail.com"), F.concat(F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit("")), F.lit("@gmail.com"))).otherwise(address)


def email_plausible(raw: Column) -> Column:
    return (F.length(raw) <= 254) & raw.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def phone(raw: Column) -> Column:
    """Digits without an extension, 10 digits with country code 1; null unless 7 to 15 digits that are not all zero."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(raw), r"(?:ext\.?|extension|x)\s*\d+\s*$", ""), r"\D", "")
    digits = F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)
    return F.when(F.length(digits).between(7, 15) & ~digits.rlike("^0+$"), digits)


def word_tokens(raw: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(fold(raw)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _joined(raw: Column, dropped: tuple[str, ...]) -> Column:
    text = F.array_join(F.filter(word_tokens(raw), lambda w: ~w.isin(*dropped)), " ")
    return F.when(text != "", text)


def name(raw: Column) -> Column:
    return _joined(raw, NAME_PREFIXES + NAME_SUFFIXES)


def company(raw: Column) -> Column:
    return _joined(raw, COMPANY_SUFFIXES)


def company_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")


def domain(url: Column) -> Column:
    """Host of a URL or bare domain, lower, without www."""
    host = F.regexp_extract(F.lower(trimmed(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.when(host.contains("."), F.regexp_replace(idna(host), r"^www\.", ""))


def stage(raw: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(raw)), r"[\s-]+", "_")


def not_placeholder(raw: Column) -> Column:
    return F.when(F.lower(trimmed(raw)).isin(*PLACEHOLDERS), "").otherwise(trimmed(raw))


def flags(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[|;,]"), header), lambda x: x != "")


def split_name(full: Column) -> tuple[Column, Column]:
    """First names and last name of a full name."""
    parts = F.filter(F.split(trimmed(full), r"\s+"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")).otherwise(F.get(parts, F.lit(0))), F.when(n > 1, F.get(parts, n - 1))


def bigrams(text: Column) -> Column:
    flat = F.replace(text, F.lit(" "), F.lit(""))
    n = F.length(flat)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: flat.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Bigram Dice similarity of multisets; 1 for equal texts; 0.6 or 0 by the initial where a text has no bigrams."""
    x, y = bigrams(a), bigrams(b)
    count = lambda arr, v: F.size(F.filter(arr, lambda w: w == v))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, v: acc + F.least(count(x, v), count(y, v)))
    none = (F.size(x) == 0) | (F.size(y) == 0)
    initial = F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.6).otherwise(0.0)
    return F.when(a == b, 1.0).when(none, initial).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def numbered_bigrams(text: Column) -> Column:
    """Bigrams, each with its number among equal ones, so that a set holds what the multiset does; null for null."""
    x = bigrams(text)
    numbered = F.transform(x, lambda w, i: F.concat(w, F.size(F.filter(F.slice(x, F.lit(1), i), lambda v: v == w)).cast("string")))
    return F.when(text.isNotNull(), numbered)


def numbered_dice(a: Column, b: Column, x: Column, y: Column) -> Column:
    """dice of a and b from their numbered bigrams x and y."""
    none = (F.size(x) == 0) | (F.size(y) == 0)
    initial = F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.6).otherwise(0.0)
    return F.when(a == b, 1.0).when(none, initial).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether texts differ by one edit, where two neighbours swapped are one."""
    n = F.length(a)
    i = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, k: F.when((acc == k - 1) & (a.substr(k, F.lit(1)) == b.substr(k, F.lit(1))), k).otherwise(acc))
    swapped = (n == F.length(b)) & (i + 2 <= n) & (F.concat(F.substring(a, F.lit(1), i), a.substr(i + 2, F.lit(1)), a.substr(i + 1, F.lit(1)), a.substr(i + 3, n)) == b)
    return (a != b) & ((F.levenshtein(a, b) <= 1) | swapped)


def email_typo(a: Column, b: Column) -> Column:
    """Same host and locals of 5 or more one edit apart, or same local and hosts one edit apart; never across a plus."""
    la, lb, ha, hb = F.substring_index(a, "@", 1), F.substring_index(b, "@", 1), F.substring_index(a, "@", -1), F.substring_index(b, "@", -1)
    return ~a.contains("+") & ~b.contains("+") & (((ha == hb) & (F.length(la) >= 5) & (F.length(lb) >= 5) & one_edit(la, lb)) | ((la == lb) & one_edit(ha, hb)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of ASCII text, 8 hexadecimal digits."""
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda acc, c: (acc.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def formula_guard(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would run."""
    return F.when(cell.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the values as a JSON array, nulls kept."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)), {"ignoreNullFields": "false"}), 256)
