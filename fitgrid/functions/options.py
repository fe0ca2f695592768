"""Lists of examples and alternatives in a sentence: what they name is not asked for item by item."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

# Cues of examples and what ends them, the grammar of a list that ends in "or", and the ends that make a list one
# of equivalents or one of what is asked for.
EXAMPLES = r"\b(?:e\.g|for example|for instance|z\.\s?b|zum beispiel|any one of|one of|any of)\b\.?|наприклад"
EXAMPLES_END = r"[);]"
WORD = r"(?!(?:and|und|та|і)\b)[\w+#./\-'’]+"
ITEM = rf"{WORD}(?: {WORD}){{0,2}}"
OR_LIST = rf"(?:{ITEM}\s*,\s*)*{ITEM}\s*,?\s*\b(?:or|oder|або|чи)\b\s+{ITEM}(?=\s*(?:[,;:().]|$|\b(?:is|are|would|and)\b))"
EQUIVALENT, OTHER = r"\bor (?:equivalent|similar)\b", r"\bor (?:other|any other)\b"

#: What a sentence must have to hold such a list at all.
CUE = r"(?iU)\b(?:or|oder|або|чи|e\.g|for example|for instance|z\.\s?b|zum beispiel|any of|one of)\b|наприклад"
_examples, _end, _list, _equivalent, _other = (re.compile(x, re.IGNORECASE) for x in (EXAMPLES, EXAMPLES_END, OR_LIST, EQUIVALENT, OTHER))


def lists_of(sentence: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, sure) of each list: examples from their cue to a bracket or the end, and items joined by "or" unless it goes on
    with "or other". A list that is not ``sure`` counts only if two skills or more are in it."""
    for found in _list.finditer(sentence):
        items = found[0]
        if _other.search(items) is None:
            yield found.start(), found.end(), _equivalent.search(items) is not None
    for cue in _examples.finditer(sentence):
        stop = _end.search(sentence, cue.end())
        yield cue.end(), stop.start() if stop else len(sentence), True


_LISTS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("sure", BooleanType())]))


@F.pandas_udf(_LISTS)
def _lists(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [dict(zip(("start", "end", "sure"), x, strict=True)) for x in lists_of(t)] if isinstance(t, str) else [])


def option_lists(sentence: Column) -> Column:
    """Array of start, end (code points from 0) and sure; sentences without a cue do not leave the JVM."""
    none = F.array().cast("array<struct<start:int,end:int,sure:boolean>>")
    return F.when(sentence.rlike(CUE), _lists(F.when(sentence.rlike(CUE), sentence))).otherwise(none)
