"""Column functions over dirty text: numbers, names, keys, markup. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
MISSING_WORDS = ["nan", "none", "null"]
MISSING_NUMBERS = [*MISSING_WORDS, "khong xac dinh", "n a"]
EMPTY_MARKERS = ["", "---", "--", "-", "_", "n/a", "không", "khong"]

# Letters and the plain letter that each stands for.
ACCENTS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịïī", "o": "òóỏõọôồốổỗộơờớởỡợöō", "u": "ùúủũụưừứửữựüū", "y": "ỳýỷỹỵÿ", "d": "đ", "n": "ñ", "c": "ç",
}

# Abbreviations, in the order in which they are written out.
ABBREVIATIONS = [
    (r"\btp\s*\.?\s*hcm\b", " ho chi minh "),
    (r"\btphcm\b", " ho chi minh "),
    (r"\bhcm\b", " ho chi minh "),
    (r"\bsai\s*gon\b", " ho chi minh "),
    (r"\bsg\b", " ho chi minh "),
    (r"\bha\s*noi\b", " ha noi "),
    (r"\bhn\b", " ha noi "),
    (r"\bt\s*\.?\s*p\b\s*\.?", " thanh pho "),
    (r"\btp\s*\.?", " thanh pho "),
    (r"\btt(?:\s*\.\s*|\s)", " thi tran "),
    (r"\btx(?:\s*\.\s*|\s)", " thi xa "),
    (r"\bq\s*\.?\s*(\d+)\b", " quan $1 "),
    (r"\bq\s*\.\s*", " quan "),
    (r"\bh\s*\.\s*", " huyen "),
    (r"\bp\s*\.\s*", " phuong "),
    (r"\bx\s*\.\s*", " xa "),
]
# A ward by its number alone, so that it is not taken for a district.
NUMBERED_WARD = (r"\bp\s*(\d+)\b", " phuong $1 ")

# The units that a place's name can begin with.
UNIT_PREFIX = r"^((thanh pho|tinh|quan|huyen|thi xa|thi tran|phuong|xa)\s+)+"
WARD_PREFIX = r"^(phuong|xa|thi tran)\s"

# Character references.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "amp": "&"}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_accents(c: Column) -> Column:
    """Accented letters to plain ones; combining marks go too."""
    plain = "".join(k * len(v) for k, v in ACCENTS.items())
    marked = "".join(ACCENTS.values())
    return F.regexp_replace(F.translate(c, marked + marked.upper(), plain + plain.upper()), r"\p{Mn}", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Plain lower-case words, one space between them, abbreviations written out.

    Full stops stay until then, as they tell an abbreviated unit from a letter.
    """
    plain = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9.]+", " ")
    rules = (*ABBREVIATIONS, NUMBERED_WARD)
    out = plain
    for pattern, full in rules:
        out = F.regexp_replace(out, pattern, full)
    # most texts hold no abbreviation: one look tells
    out = F.when(plain.rlike("|".join(pattern for pattern, _ in rules)), out).otherwise(plain)
    return squeeze(F.regexp_replace(out, "[^a-z0-9]+", " "))


def core_name(c: Column) -> Column:
    """norm_text without the unit words that it begins with."""
    return F.regexp_replace(norm_text(c), UNIT_PREFIX, "")


def key_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def to_text(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when((trimmed != "") & ~F.lower(trimmed).isin(MISSING_WORDS), trimmed)


def first_number(c: Column) -> Column:
    """The first number in a text: 12, 12.5 or 12,5; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(c, r"(-?\d+(?:[.,]\d+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def to_number(c: Column) -> Column:
    """A tolerant number: a comma is a decimal point, and of several points only the last stays."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit("."))
    several = F.regexp_replace(plain, r"\.(?=[^.]*\.)", "")
    word = F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))
    found = F.nullif(F.regexp_extract(several, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(~word.isin(MISSING_NUMBERS), found)


def clean(c: Column) -> Column:
    """Null for the markers of an empty field."""
    return F.when(~F.lower(F.trim(c)).isin(EMPTY_MARKERS), F.trim(c))


def html_text(c: Column) -> Column:
    """A fragment's text: tags out, references resolved, white space collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for name, plain in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return squeeze(out)


def tokens(c: Column) -> Column:
    """An address's parts, the last first: split at commas, semicolons and slashes."""
    return F.reverse(F.filter(F.transform(F.split(text(c), "[,;/]"), lambda x: F.trim(x)), lambda x: x != ""))
