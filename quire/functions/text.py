"""Text measures, clean-up and classification as column expressions.

Patterns spell Unicode classes out, so that they mean the same in the JVM and in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
CONFUSIONS = (("rn", "m"), ("li", "h"), ("1", "l"), ("0", "o"), ("cl", "d"), ("vv", "w"), ("||", "ll"))
LEFT_ALONE = ("1", "0", "I", "a", "i")
PUNCTUATION = ".,!?;:\"'()[]{}"
FAMILIES = {"zh": "cjk", "ja": "cjk", "ko": "cjk", "ar": "arabic", "fa": "arabic", "ur": "arabic", "th": "thai"}
SPACES = {"default": (0.08, 0.25), "cjk": (0.0, 0.05), "arabic": (0.05, 0.15), "thai": (0.0, 0.08)}
SCRIPTS = (("cjk", "[一-鿿㐀-䶿가-힯぀-ヿ]"), ("arabic", "[؀-ۿ]"), ("thai", "[฀-๿]"))
RTL = r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}‫‮‏]"
OSD = {"Latin": "latin", "Han": "cjk", "Hangul": "cjk", "Japanese": "cjk", "HanS": "cjk", "HanT": "cjk", "Arabic": "arabic", "Cyrillic": "cyrillic", "Devanagari": "unknown", "Bengali": "unknown", "Tamil": "unknown", "Hebrew": "arabic"}
LABELS = {"body": ("Text", "List-item", "Formula", "Equation"), "heading": ("Title",), "table": ("Table",), "figure": ("Figure",), "caption": ("Caption",), "header": ("Page-header", "Header"), "footer": ("Page-footer", "Footer"), "footnote": ("Footnote",)}
TRUST = {"pymupdf_direct": 1.0, "surya_layout": 0.9, "surya_ocr": 0.8, "tesseract_ocr": 0.7}


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank(t: Column) -> Column:
    return ~F.coalesce(t, F.lit("")).rlike(r"[^\s\p{Z}]")


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != "")


def count_of(t: Column, chars: str) -> Column:
    """Characters of t in a class like [a-z]."""
    inverse = "[" + chars[2:] if chars.startswith("[^") else "[^" + chars[1:]
    return F.length(F.regexp_replace(t, inverse, ""))


def printable(t: Column) -> Column:
    """Visible characters: neither control, unassigned nor white. Only texts with other such characters than the plain space are searched for them."""
    return F.when(t.rlike(r"[\p{C}\p{Z}\s&&[^ ]]"), F.length(F.regexp_replace(t, r"[\p{C}\p{Z}\s]", ""))).otherwise(F.length(t) - spaces(t))


def spaces(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))


def lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def script_family(language: Column, sample: Column) -> Column:
    told = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.lower(F.substring_index(language, "-", 1))]
    seen = F.lit("default")
    for name, chars in reversed(SCRIPTS):
        seen = F.when(count_of(sample, chars) > 0.30 * F.length(sample), name).otherwise(seen)
    latin = ~sample.rlike("[^\u0000-\u05ff]")  # no character of any of the scripts
    return F.coalesce(told, F.when((language.isNotNull() & (language != "")) | latin, "default"), seen)


def direction(t: Column) -> Column:
    right = F.length(t) - F.length(F.regexp_replace(t, RTL, ""))
    left = F.length(F.regexp_replace(F.regexp_replace(t, RTL, ""), r"[^\p{L}]", ""))
    return F.when(t.rlike(RTL) & (right > 0.30 * (right + left)), "rtl").otherwise("ltr")


def quality(t: Column, language: Column) -> Column:
    """Mean of space, visible and replacement character scores in 0 to 1; 0 for an empty text."""
    broken = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    seen = F.struct(F.length(t).cast("double").alias("n"), spaces(t).alias("sp"), printable(t).alias("pr"), broken.alias("br"), script_family(language, t).alias("family"))

    def score(m: Column) -> Column:
        ratio, lo, hi = m["sp"] / m["n"], lookup(m["family"], {k: v[0] for k, v in SPACES.items()}, 0.08), lookup(m["family"], {k: v[1] for k, v in SPACES.items()}, 0.25)
        short = F.when(lo > 0, F.try_divide(ratio, lo)).otherwise(1.0)
        space = F.when(ratio.between(lo, hi), 1.0).when(ratio < lo, short).otherwise(F.greatest(F.lit(0.0), 1.0 - (ratio - hi) / (1.0 - hi + 1e-9)))
        whole = F.greatest(F.lit(0.0), 1.0 - m["br"] / m["n"] * 10)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * space + 0.4 * (m["pr"] / m["n"]) + 0.2 * whole))

    return F.when(F.length(t) > 0, let(seen, score)).otherwise(0.0)


def fingerprint(t: Column) -> Column:
    """Text without section and page numbers, other numbers as #, in lower case."""
    for pattern, by in ((r"^\p{Nd}[\p{Nd}.]*[\s\p{Z}]+", ""), (r"[\s\p{Z}]+\p{Nd}+$", ""), (r"\p{Nd}+", "#")):
        t = F.regexp_replace(strip(t) if by == "" and pattern[0] == "^" else t, pattern, by)
    return strip(F.lower(t))


def clean_replacements(t: Column) -> Column:
    return F.when(~t.rlike("[^�\\s]"), F.when(t.contains("�"), "").otherwise(t)).otherwise(F.regexp_replace(t, "�+", "[?]"))


#: The last + has the JVM go through a run in a loop, not one call deeper a letter; nothing is given back, as nothing follows.
SPACED = r"(?:[A-Z]{1,2})(?:\s+(?:[A-Z]{1,2})){2,}+"


def collapse_spaced(t: Column) -> Column:
    """Runs of spaced capitals drawn together."""
    return F.array_join(F.zip_with(F.split(t, SPACED, -1), F.array_append(F.regexp_extract_all(t, F.lit(SPACED), F.lit(0)), F.lit("")), lambda p, m: F.concat(p, F.regexp_replace(m, r"\s+", ""))), "")


def dehyphenate(t: Column) -> Column:
    """Words cut at line ends made whole. A word is tried from its first letter only: from each, a long one would take the square of its length."""
    return F.regexp_replace(t, rf"(?<!{WORD})({WORD}++)-\s*[\r\n]+\s*({WORD}+)", "$1$2")


def _tokens(t: Column) -> Column:
    """Words and the white space between them, in turn."""
    return F.regexp_extract_all(t, F.lit(r"\s+|\S+"), F.lit(0))


def fix_confusions(t: Column) -> Column:
    """Every confusion replaced in every word but a few, one after another."""

    def fix(w: Column) -> Column:
        out = w
        for wrong, right in CONFUSIONS:
            out = F.replace(out, F.lit(wrong), F.lit(right))
        return F.when(w.isin(*LEFT_ALONE), w).otherwise(out)

    return F.array_join(F.transform(_tokens(t), fix), "")


def bare(w: Column) -> Column:
    return F.lower(F.btrim(w, F.lit(PUNCTUATION)))


def fix_confusions_known(t: Column, dictionary: Column) -> Column:
    """The first replacement that makes a known word of an unknown one; dictionary is an array of words. White space and words without a confusion aren't looked up."""
    confused = "|".join(wrong.replace("|", "\\|") for wrong, _ in CONFUSIONS)

    def fix(w: Column) -> Column:
        out = w
        for wrong, right in reversed(CONFUSIONS):
            other = F.replace(w, F.lit(wrong), F.lit(right))
            out = F.when(F.contains(w, F.lit(wrong)) & F.array_contains(dictionary, bare(other)), other).otherwise(out)
        return F.when(~w.rlike(confused), w).when(w.isin(*LEFT_ALONE) | F.array_contains(dictionary, bare(w)), w).otherwise(out)

    return F.array_join(F.transform(_tokens(t), fix), "")


def guess_language(language: Column, t: Column) -> Column:
    """The given language, else en where half of the characters are ASCII letters."""
    return F.coalesce(language, F.when(~blank(t) & (count_of(t, "[A-Za-z]") >= 0.5 * F.length(t)), "en"))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; two empty texts are equal."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))).cast("double"))


def label_type(label: Column) -> Column:
    return lookup(label, {x: kind for kind, names in LABELS.items() for x in names}, "body")


def osd_script(name: Column) -> Column:
    return lookup(name, OSD, "unknown")


def is_encryption_error(message: Column) -> Column:
    return F.lower(message).rlike("password|encrypted|incorrect")


def midpoint_excerpt(t: Column, around: int = 100) -> Column:
    mid = F.floor(F.length(t) / 2).cast("int")
    low = F.greatest(F.lit(0), mid - around)
    return F.substr(t, low + 1, mid + around - low)


def tsv(rows: Column) -> Column:
    """Rows of cells as tab separated lines; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")


CAPITALS = r"[A-Z][A-Z\s]{2,}"
TITLE = r"(?:[A-Z][a-z]+\s*){1,6}"
NUMBERED = r"\p{Nd}[\p{Nd}.]*\s+(?:\S+\s*){1,8}"
HEADING = f"^(?:{'|'.join((CAPITALS, TITLE, NUMBERED))})$"


def looks_like_heading(t: Column, high: Column, body: Column, ratio: float = 1.15, most: int = 80) -> Column:
    s = strip(t)
    return (s != "") & (F.length(s) <= most) & (((body > 0) & (high >= body * ratio)) | s.rlike(HEADING))
