"""Text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that end a company's name (fixed values).
LEGAL_FORMS = ("ltd", "limited", "plc", "llp", "inc", "llc", "gmbh", "bv", "sarl", "co", "corp", "company")
#: Words too common to tell names apart (fixed values).
COMMON_WORDS = ("the", "and", "of", "for", "group", "holdings", "uk", "international")
#: Free mail hosts (fixed values).
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com")
#: Path parts of article pages (fixed values).
ARTICLE_MARKS = ("news", "blog", "article", "story", "press")


def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and marks, their bases, and then the marks, which go."""
    pairs = []
    for code in range(0xA0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def text(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_accents(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


def normalise(c: Column | str) -> Column:
    """Without accents, lower case, & spelled out, all but letters, digits and _ as single spaces, trimmed; null is ''."""
    plain = F.replace(F.lower(strip_accents(text(c))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_]", " "), " +", " "))


def company_name(c: Column | str) -> Column:
    """Normalised, without legal forms at the end and a leading `the`."""
    forms = "|".join(LEGAL_FORMS)
    return F.regexp_replace(F.regexp_replace(normalise(c), f"( ?\\b({forms}))+$", ""), "^(the )+", "")


def name_key(c: Column | str) -> Column:
    return F.replace(company_name(c), F.lit(" "), F.lit(""))


def tokens(c: Column) -> Column:
    """The distinct words of a normalised text in order."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def has_legal_form(c: Column | str) -> Column:
    return F.arrays_overlap(F.split(normalise(c), " "), F.array(*map(F.lit, LEGAL_FORMS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def subset(a: Column, b: Column, proper: bool = True) -> Column:
    inside = F.size(F.array_except(a, b)) == 0
    return inside & (F.size(a) < F.size(b)) if proper else inside


def missing(a: Column, b: Column) -> Column:
    """What only one of two token arrays has."""
    return F.array_except(F.array_union(a, b), F.array_intersect(a, b))


def distinctive(words: Column) -> Column:
    """Tokens longer than two characters that are not common."""
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS))


def first_of(marks: tuple[str, ...], c: Column) -> Column:
    """The first mark, in their order, that a text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(m)), F.lit(m)) for m in marks])


def hits(marks: tuple[str, ...], c: Column) -> Column:
    """How many of the marks a text contains."""
    return sum((F.contains(c, F.lit(m)).cast("int") for m in marks), F.lit(0))


def head_noun(c: Column) -> Column:
    return F.element_at(F.split(c, " "), -1)


def summarise(c: Column | str, limit: int = 220) -> Column:
    """White space collapsed; cut at the limit, without a last partial word, and marked as cut."""
    flat = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("…")))


def domain(url: Column) -> Column:
    """Lower-case host with port, without www."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), "^[^@]*@", ""), r"^www\.", "")


def site_root(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")


def is_article(url: Column) -> Column:
    parts = path_parts(url)
    return F.arrays_overlap(parts, F.array(*map(F.lit, ARTICLE_MARKS))) | (F.size(parts) > 1)


def domain_suffixes(host: Column) -> Column:
    """The host and each of its parent domains, longest first, so that suffix rules become an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def clean(c: Column | str, limit: int) -> Column:
    """Printable characters only, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(text(c), r"\p{C}", "")), 1, limit)


def salted_hash(c: Column | str, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), text(c)), 256), 1, 32)


def hyperlink(c: Column | str, fallback: str = "") -> Column:
    """The first link of a cell, with https; else the fallback."""
    link = F.nullif(F.regexp_extract(text(c), r"(https?://[^\s\"'<>]+)", 1), F.lit(""))
    return F.coalesce(F.regexp_replace(link, "^http://", "https://"), F.lit(fallback))


def postcode_area(c: Column) -> Column:
    return F.nullif(F.substring_index(F.trim(c), " ", 1), F.lit(""))


def searchable(*columns: Column) -> Column:
    """Lower-case fields joined by one space; null and empty ones are left out."""
    return F.lower(F.array_join(F.filter(F.array(*columns), lambda x: x != ""), " "))


def first_evidence(reasons: Column, marks: tuple[str, ...], default: str) -> Column:
    """The first reason with a mark, else the first reason, else the default."""
    marked = F.filter(reasons, lambda r: F.coalesce(*[F.when(F.contains(F.lower(r), F.lit(m)), True) for m in marks], F.lit(False)))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(reasons, F.lit(0)), F.lit(default))


def render(template: str, **values: Column) -> Column:
    """Fill {name}s. A bracketed part with a name that is null goes; a null outside brackets is empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.when(value.isNull(), F.regexp_replace(out, r"\s*\([^()]*\{" + name + r"\}[^()]*\)", "")).otherwise(out)
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.trim(out)


def leftover_tokens(c: Column) -> Column:
    """Template tokens {{NAME}} that were not filled."""
    return F.regexp_extract_all(c, F.lit(r"\{\{[A-Z_]+\}\}"), F.lit(0))


def template_body(c: Column) -> Column:
    """What stands between the first two rules of a template; all of it where there are fewer."""
    parts = F.split(c, "\n---\n")
    return F.trim(F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(c))


def substituted(c: Column, **values: Column) -> Column:
    """The template with each {{NAME}} that has a value replaced; null is empty."""
    for name, value in values.items():
        c = F.replace(c, F.lit("{{" + name + "}}"), text(value.cast("string")))
    return c


def is_email(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), F.lit(False))


def is_work_email(c: Column) -> Column:
    return is_email(c) & ~F.lower(F.substring_index(F.trim(c), "@", -1)).isin(*FREE_MAIL)


def has_street(c: Column) -> Column:
    return text(c).rlike(r"(?i)\b\d{1,4}[a-z]?\s+\p{L}+\s+(street|road|lane|avenue|st|rd)\b")


def dedupe_key(number: Column, mark: Column, applicant: Column) -> Column:
    """The first 32 hex digits of a hash over the three; null is ''."""
    return F.substring(F.sha2(F.concat(F.upper(F.trim(text(number))), F.lit("|"), F.lower(F.trim(text(mark))), F.lit("|"), F.lower(F.trim(text(applicant)))), 256), 1, 32)
