"""Descriptions of postings as cleaned lines, from HTML or plain text, and the skills that lines name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .text import normal_words

# Limits, and what makes a line.
MAX_INPUT_CHARS, MIN_USABLE_CHARS, MAX_HEADING_CHARS, MAX_HEADING_WORDS = 50_000, 200, 80, 8
HTML_HINT = re.compile(r"<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*[\s/>]")
BULLET = re.compile(r"^\s*(?:[-*•–·▪●‣⁃]|\d{1,2}[.)])\s+")
BLOCKS = frozenset("p div br li ul ol tr table section article header footer blockquote pre h1 h2 h3 h4 h5 h6 dt dd hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOLD, SKIPPED = frozenset(("b", "strong")), frozenset(("script", "style", "noscript", "template"))
SOFT_HYPHEN = "­"
GENERIC = ("data", "support", "management", "development", "software", "engineering", "work", "team", "business", "product", "service", "services", "it", "web", "tools", "tool", "technology", "technologies", "systems", "system", "solutions", "experience", "knowledge", "skills", "skill", "office", "computer", "internet", "email", "online", "digital", "platform", "process", "processes", "quality", "project", "projects", "technical skills", "soft skills", "lead", "plan", "design", "call", "source", "clean", "discipline", "schedule", "feedback", "reporting", "activity", "interaction", "craft", "history", "purchase", "rights", "brands", "fuel", "did", "scratch", "reserve", "innovation", "innovate", "processor", "credibility", "judgment", "commitment", "dedication", "loyalty", "confidence", "hybrid model", "remote")
TOKEN = r"(?U)[\w][\w+#./\-']*[\w+#]|[\w][+#]*|\.[\w]+"
MAX_ALIAS_WORDS = 5
#: Bytes of a vocabulary up to which it goes to every executor.
MOST_BYTES = 8 << 20


def clean_text(text: str) -> str:
    """NFKC; a word broken by a hyphen at a line's end is joined if it goes on in lower case; single spaces, no blank lines."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(rf"(?<=[^\W\d_])[-{SOFT_HYPHEN}]\n(?=([^\W\d_]))", lambda m: "" if m[1].islower() else m[0], text)
    squeezed = (" ".join(line.split()) for line in text.replace(SOFT_HYPHEN, "").split("\n"))
    return "\n".join(filter(None, squeezed))


class _Reader(HTMLParser):
    """Collects (text, heading, bullet): a line ends at every block; it is a heading in an hN or if all of it is bold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        self.depth = dict.fromkeys(("heading", "bold", "skipped"), 0)
        self.text, self.plain, self.bullet = "", False, False

    def _kind(self, tag: str) -> str | None:
        return "heading" if tag in HEADINGS else "bold" if tag in BOLD else "skipped" if tag in SKIPPED else None

    def end_line(self) -> None:
        text = " ".join(self.text.split())
        if text:
            self.lines.append((text, (self.depth["heading"] > 0 or not self.plain) and _is_short(text), self.bullet))
        self.text, self.plain, self.bullet = "", False, False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            self.bullet = tag == "li"
        if kind := self._kind(tag):
            self.depth[kind] += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        if kind := self._kind(tag):
            self.depth[kind] = max(0, self.depth[kind] - 1)

    def handle_data(self, data):
        if not self.depth["skipped"]:
            self.plain |= bool(data.strip()) and not (self.depth["bold"] or self.depth["heading"])
            self.text += data


def _is_short(text: str) -> bool:
    return len(text) <= MAX_HEADING_CHARS and text.count(" ") < MAX_HEADING_WORDS


def _is_title(text: str) -> bool:
    words = text.split(" ")
    return 3 <= len(words) <= 6 and text[-1] not in ".!?,;)" and all(w[0].isupper() for w in words if len(w) > 3)


def posting_lines(description: str | None) -> list[tuple[str, bool, bool, bool]]:
    """Lines (text, heading, bullet, title) of a description, whose first 50,000 characters count as the feeds define it."""
    raw = (description or "")[:MAX_INPUT_CHARS]
    if HTML_HINT.search(raw):
        reader = _Reader()
        reader.feed(raw)
        reader.close()
        reader.end_line()
        found = reader.lines
    else:
        found = [(line, False, False) for line in raw.splitlines()]
    out = []
    for text, heading, bullet in found:
        text = clean_text(text).replace("\n", " ")
        mark = BULLET.match(text)
        text = text[mark.end() :].strip() if mark else text
        if text:
            bullet = bullet or mark is not None
            heading = not bullet and (heading or (text.endswith(":") and _is_short(text)))
            out.append((text, heading, bullet, not (heading or bullet) and _is_title(text)))
    return out


LINE = StructType([StructField("text", StringType()), *(StructField(n, BooleanType()) for n in ("heading", "bullet", "title"))])


@F.pandas_udf(ArrayType(LINE))
def lines_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: [dict(zip(LINE.names, line, strict=True)) for line in posting_lines(t)])


@F.arrow_udf(ArrayType(LINE))
def usable_lines_of(texts: pa.Array) -> pa.Array:
    """Lines of texts that have enough to read requirements from (see ``is_usable``), none of others."""
    rows, ends = [], [0]
    for t in texts.to_pylist():
        found = posting_lines(t)
        if sum(len(x[0]) for x in found) >= MIN_USABLE_CHARS:
            rows += found
        ends.append(len(rows))
    kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    fields = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, LINE.names))


def is_usable(lines: Column) -> Column:
    """Enough text to read requirements from."""
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x["text"])) >= MIN_USABLE_CHARS


def tokens(text: Column) -> Column:
    """Words with the marks that skills have ("C++", ".NET", "Node.js"); none ends in a mark that ends a sentence."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def telling(vocabulary: DataFrame) -> DataFrame:
    """The aliases (alias_norm) that say something by themselves."""
    return vocabulary.filter(~F.col("alias_norm").isin(*GENERIC))


def skill_hits(lines: DataFrame, keys: list[str], vocabulary: DataFrame, most_words: int = MAX_ALIAS_WORDS) -> DataFrame:
    """The skills (vocabulary: alias_norm, weak) that texts name: from the left the longest run of words that is one,
    no word in two; of a word with slashes that begins none, the parts that are. Rows of ``keys``, place (word, from 1), skill
    as written, norm, weak; parts of a word share its place.

    Only words that begin an alias, or have a slash, become runs. Words are brought to their normal form a text at a time; a
    word goes on with those that may follow it in a run, never with its whole text. Runs of up to ``most_words`` words meet the
    vocabulary in an equi-join, without a shuffle where it is small; the choice among overlapping ones is made in one pass over
    a text's hits.
    """
    known = vocabulary.select(F.col("alias_norm").alias("norm"), "weak").dropDuplicates(["norm"])
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("norm")), F.lit(0))).collect()[0]
    small = 200 * n + size <= MOST_BYTES
    words = lines.select(*keys, F.col("text").alias("__text"), tokens(F.col("text")).alias("w")).select(*keys, "w", normal_words(F.col("__text"), F.col("w")).alias("n"))
    # outer, as the filter that the planner infers from an inner one would take all words from every text twice
    runs = words.select(*keys, "w", "n", F.posexplode_outer("n").alias("__at", "norm")).filter("norm IS NOT NULL").withColumn("__at", F.col("__at") + 1)
    if small:
        first = known.select(F.substring_index("norm", " ", 1).alias("first")).distinct().select("first", F.lit(True).alias("begins"))
        runs = runs.withColumn("first", F.substring_index("norm", " ", 1)).join(F.broadcast(first), "first", "left").filter("begins OR contains(norm, '/')")
    runs = runs.select(*keys, "__at", *(F.slice(c, F.col("__at"), most_words).alias(c) for c in ("w", "n")))
    word, norm = F.col("w")[0], F.col("n")[0]
    joined = lambda c, k: F.array_join(F.slice(c, F.lit(1), k), " ")
    whole = F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(most_words))), lambda k: F.struct((-k).alias("less"), F.lit(0).alias("part"), joined("w", k).alias("skill"), joined("n", k).alias("norm")))
    parts = F.when(word.contains("/"), F.zip_with(F.split(word, "/"), F.split(norm, "/"), lambda x, y: F.struct(x.alias("skill"), y.alias("norm"))))
    parts = F.transform(parts, lambda x, i: F.struct(F.lit(0).alias("less"), i.alias("part"), x["skill"].alias("skill"), x["norm"].alias("norm")))
    runs = runs.select(*keys, "__at", F.explode(F.concat(whole, F.coalesce(parts, F.array().cast("array<struct<less:int,part:int,skill:string,norm:string>>")))).alias("r")).filter("r.skill <> ''").select(*keys, "__at", "r.*")
    # by their size at the source, which knows nothing of the runs, the planner would take these for the smaller side
    met = runs.join(F.broadcast(known), "norm") if small else runs.hint("merge").join(known, "norm")
    hit = F.struct("__at", "less", "part", "skill", "norm", "weak")
    per = met.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # of a place the longest first, parts last
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("split"), F.array().cast("array<int>").alias("taken"))

    def choose(acc: Column, x: Column) -> Column:
        free = (x["__at"] >= acc["next"]) | ((x["less"] == 0) & (acc["split"] == x["__at"]))
        taken = F.concat(acc["taken"], F.array(x["i"]))
        split = F.when(x["less"] == 0, x["__at"]).otherwise(0)
        return F.when(free, F.struct((x["__at"] + F.greatest(-x["less"], F.lit(1))).alias("next"), split.alias("split"), taken.alias("taken"))).otherwise(acc)

    chosen = F.aggregate(F.transform("hits", lambda x, i: F.struct(x["__at"], x["less"], i.alias("i"))), start, choose)["taken"]
    kept = per.select(*keys, F.explode(F.transform(chosen, lambda i: F.get("hits", i))).alias("x"))
    return kept.select(*keys, F.col("x.__at").alias("place"), "x.skill", "x.norm", "x.weak")


def posting_head(title: Column, company: Column, tags: Column, category: Column) -> Column:
    """What a posting says about its industry before its text."""
    empty = F.lit("")
    return F.concat_ws(" ", title, F.coalesce(company, empty), F.array_join(tags, " "), F.coalesce(category, empty))
