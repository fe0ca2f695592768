"""Headings of a CV: which texts may be one, and what sections their words name."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .blocks import heading_key, once
from .fuzzy import Pattern

# Words of headings by kind of section, the least likeness of a misspelled one and its least length, what parts
# a heading, the most words and characters of one, marks of lists.
KEYWORDS = {
    "contact": ("contact", "contacts", "contact information", "contact details", "personal details", "контакти", "контактна інформація"),
    "summary": ("summary", "profile", "about me", "objective", "про себе"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "work history", "career history", "internships", "досвід роботи", "досвід"),
    "education": ("education", "academic background", "qualifications", "освіта"),
    "skills": ("skills", "technical skills", "core competencies", "tech stack", "technologies", "tools", "навички", "ключові навички"),
    "projects": ("projects", "personal projects", "проєкти"),
    "certifications": ("certifications", "certificates", "courses", "licenses", "сертифікати", "курси"),
    "languages": ("languages", "мови"),
}
LIKE, LIKE_LENGTH = 90.0, 4
PARTS = re.compile(r"\s*[&/|,]\s*|\s+(?:and|та|і)\s+")
WORDS, CHARS = 5, 40
BULLETS = "•●▪■◦○♦►▸*·–—-"

_KIND = {word: kind for kind, words in KEYWORDS.items() for word in words}
_CLOSED = {word.replace(" ", ""): kind for word, kind in _KIND.items()}
_PATTERNS = [(Pattern(word), kind) for word, kind in (_CLOSED | _KIND).items()]


def kind_of(part: str) -> tuple[str, str] | None:
    """The kind of section that a part of a heading names, and how: by keyword, with or without spaces, or nearly (fuzzy)."""
    closed = part.replace(" ", "")
    kind = _KIND.get(part) or _CLOSED.get(closed)
    if kind:
        return kind, "keyword"
    if len(part) < LIKE_LENGTH:
        return None
    best, found = LIKE, None
    for pattern, kind in _PATTERNS:
        both = len(part) + len(pattern.text)
        if 200.0 * min(len(part), len(pattern.text)) < best * both:
            continue  # lengths too different for what has been found
        score = pattern.ratio(part)
        if score > best or (found is None and score >= best):
            best, found = score, kind
    return (found, "fuzzy") if found else None


def kinds_of(key: str) -> tuple[list[str], str] | None:
    """Kinds of the sections that a heading's key names, each once; parts that name none are "other", if any names one."""
    found = [kind_of(p) for p in dict.fromkeys(p for p in (p.strip() for p in PARTS.split(key)) if p)]
    if not any(found):
        return None
    return list(dict.fromkeys(f[0] if f else "other" for f in found)), "fuzzy" if any(f and f[1] == "fuzzy" for f in found) else "keyword"


@lru_cache(1 << 16)
def _kinds_of(key: str) -> tuple[list[str], str] | None:
    return kinds_of(key)


@F.arrow_udf(StructType([StructField("types", ArrayType(StringType())), StructField("source", StringType())]))
def key_kinds(keys: pa.Array) -> pa.Array:
    """Types and source of the keys of headings, each distinct key compared once; both NULL of a key that is none or names none."""
    coded = keys.dictionary_encode()
    found = [(k and _kinds_of(k)) or (None, None) for k in [*coded.dictionary.to_pylist(), None]]
    types, source = pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.string())
    return pa.StructArray.from_arrays([types, source], ["types", "source"]).take(coded.indices.fill_null(len(found) - 1))


#: A text that is short enough and of one line, less the white space around it: most texts fail after a few characters.
SHORT = rf"(?U)^\s*+(\S(?:[^\n]{{0,{CHARS - 2}}}\S)?)\s*+\z"


def heading_of(text: Column) -> Column:
    """The key of a text that may be a heading by its shape, else NULL: short, of one line, no sentence, no item of a list."""

    def key_of(t: Column) -> Column:
        shape = (t != "") & ~t.rlike(r"[.,]$") & ~F.substring(t, 1, 1).isin(*BULLETS)
        return F.when(shape, once(heading_key(t), lambda k: F.when((k != "") & (F.size(F.split(k, " ")) <= WORDS), k)))

    return once(F.regexp_extract(text, SHORT, 1), key_of)


def may_be_heading(text: Column) -> Column:
    return heading_of(text).isNotNull()


def heading_kinds(text: Column) -> Column:
    """Struct of types and source; both NULL where the text cannot be a heading or names no kind of section."""
    return key_kinds(heading_of(text))
