"""CVs cut into sections: by headings of known words, and by the style that these have in the document.

Blocks are rows (doc_id, i, text, start, size, bold) in order of ``i``. Everything is a window or an aggregate by document,
so documents spread over tasks; only words of headings are compared in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import saved

from ..functions.headings import CHARS, heading_of, key_kinds

# How much larger than the body a large heading is, how many blocks may share the headings' style before it says
# nothing, sizes that count as one, and the least digits of a telephone number.
LARGE, GUARD, TOLERANCE, PHONE = 1.15, 12, 0.5, 9
INLINE = rf"(?s)^([^\n:–—-]{{1,{CHARS}}}?)\s*[:–—-]\s*(\S.*)$"
EMAIL, PROFILE = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?i)(?:linkedin\.com/in|github\.com|t\.me|telegram\.me)/\S+"
NUMBER, YEARS = r"\+?\(?\d[\d\s().-]{6,}\d", r"^(?:19|20)\d\d$"


def all_caps(text: Column) -> Column:
    """Two letters or more, and capitals only; most texts end the search at their second letter."""
    return ~text.rlike(r"[\p{L}&&[^\p{Lu}]]") & text.rlike(r"\p{L}[^\p{L}]*\p{L}")


def style(size: Column, bold: Column, text: Column) -> Column:
    """What a heading looks like: size in whole points, bold, capitals."""
    return F.struct(F.bround(size).cast("int").alias("size"), F.coalesce(bold, F.lit(False)).alias("bold"), all_caps(text).alias("caps"))


def weaker(own: Column, level: Column) -> Column:
    """Smaller than the level's headings, or of their size and without their weight or capitals."""
    smaller, larger = own["size"] < level["size"] - TOLERANCE, own["size"] > level["size"] + TOLERANCE
    lacks = (level["bold"] & ~own["bold"]) | (level["caps"] & ~own["caps"])
    return F.coalesce(F.when(smaller, True).when(larger, False), lacks)


def body_size(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """The median size by characters: the least size that, with all smaller ones, has half of them (by, body)."""
    per = blocks.filter("size IS NOT NULL").groupBy(by, "size").agg(F.sum(F.char_length("text")).alias("n"))
    w = Window.partitionBy(by)
    upto = F.sum("n").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("half", 2 * upto >= F.sum("n").over(w)).filter("half").groupBy(by).agg(F.min("size").alias("body"))


def contact_line(line: Column) -> Column:
    number = F.exists(F.regexp_extract_all(line, F.lit(NUMBER), 0), lambda n: (F.char_length(F.regexp_replace(n, r"\D", "")) >= PHONE) & ~F.forall(F.regexp_extract_all(n, F.lit(r"\d+"), 0), lambda g: g.rlike(YEARS)))
    return line.rlike(EMAIL) | line.rlike(PROFILE) | number


def contact_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), contact_line))


def with_headings(blocks: DataFrame) -> DataFrame:
    """Blocks with what they are: ``kind`` (standalone, inline, first_line, style or NULL), heading, types, source, confidence, where the
    heading ends, and the rest of the block (``rest``, from ``rest_start``); ``guarded`` and ``n_known`` are the document's."""
    t = F.col("text")
    marked = reduce(Column.__or__, (t.contains(c) for c in ":–—-"))  # few texts have what parts a heading from its text
    inline, first = F.when(marked, F.regexp_extract("text", INLINE, 1)), F.substring_index("text", "\n", 1)
    df = blocks.withColumns({"__style": style(F.col("size"), F.col("bold"), t), "__key": heading_of(t), "__inline": F.nullif(inline, F.lit("")), "__first": F.when(t.contains("\n"), first)})
    df = df.withColumns({"__may": F.col("__key").isNotNull(), "__alone": key_kinds(F.col("__key")), "__in": key_kinds(heading_of(F.col("__inline"))), "__of_first": key_kinds(heading_of(F.col("__first")))}).drop("__key")
    df = saved(df, "blocks")  # words are compared once, styles are read three times
    known = df.filter("__alone.types IS NOT NULL").groupBy("doc_id", "__style").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.coalesce("__style.size", F.lit(0)), "__style.bold", "__style.caps")
    level = known.groupBy("doc_id").agg(F.sum("n").alias("n_known"), F.max_by("__style", rank).alias("__level"))
    level = level.withColumn("__level", F.when(F.col("n_known") >= 2, F.col("__level")))
    df = df.join(level, "doc_id", "left").join(body_size(df), "doc_id", "left")
    own, lv = F.col("__style"), F.col("__level")
    alike = F.col("__may") & lv.isNotNull() & (own["size"].eqNullSafe(lv["size"]) & (own["bold"] == lv["bold"]) & (own["caps"] == lv["caps"]))
    doc = Window.partitionBy("doc_id")
    low = lv.isNotNull() & weaker(own, lv)
    kind = F.when(F.col("__alone.types").isNotNull(), F.when(~low, "standalone")).when(F.col("__in.types").isNotNull(), F.when(~low, "inline")).when(F.col("__of_first.types").isNotNull(), "first_line")
    df = df.withColumns({"__kind": kind, "__alike": F.coalesce(alike, F.lit(False))})
    df = df.withColumns({"guarded": F.count_if("__alike").over(doc) > GUARD, "__seen": F.coalesce(F.count("__kind").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)) > 0, F.lit(False))})
    kind = F.coalesce("__kind", F.when(F.col("__alike") & F.col("__seen") & ~F.col("guarded"), "style"))
    df = df.withColumn("kind", kind)
    k = F.col("kind")
    heading = F.when(k.isin("standalone", "style"), t).when(k == "inline", F.col("__inline")).when(k == "first_line", F.col("__first"))
    signals = F.coalesce(F.col("bold"), F.lit(False)).cast("int") + F.coalesce(F.col("size") >= LARGE * F.col("body"), F.lit(False)).cast("int") + all_caps(heading).cast("int")
    rest = F.when(k == "inline", F.regexp_extract("text", INLINE, 2)).when(k == "first_line", F.substring(t, F.char_length("__first") + 2, 1 << 30))
    named = F.when(k == "standalone", F.col("__alone")).when(k == "inline", F.col("__in")).when(k == "first_line", F.col("__of_first"))
    df = df.withColumns({
        "heading": heading,
        "types": F.when(k == "style", F.array(F.lit("other"))).otherwise(named["types"]),
        "source": F.when(k == "style", "style").otherwise(named["source"]),
        "confidence": F.when(k.isin("standalone", "inline") & (signals >= 2), "high").when(k.isNotNull(), "low"),
        "heading_end": F.col("start") + F.char_length(heading),
        "rest": rest,
        "rest_start": F.col("start") + F.char_length(t) - F.char_length(rest),
    })
    return df.drop(*(c for c in df.columns if c.startswith("__")), "body")


def sections(blocks: DataFrame) -> DataFrame:
    """doc_id, n (from 0), types, heading, content_start, end, confidence, source, blocks (text, start): every block is in
    exactly one section, in order.

    What comes before the first heading is contact details or a summary; a document without headings is one section of its own.
    Contact blocks at the end of a section that is none of contacts become a section; others within one are named in its types.
    """
    doc = Window.partitionBy("doc_id")
    df = with_headings(blocks)
    df = df.withColumns({"s": F.count("kind").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), "headed": F.count("kind").over(doc) > 0})
    heads = df.filter("kind IS NOT NULL").select("doc_id", "s", "heading", "types", "source", "confidence", "heading_end")
    held = df.filter("kind IS NULL OR rest IS NOT NULL").select("doc_id", "s", "i", "headed", F.coalesce("rest", "text").alias("text"), F.coalesce("rest_start", "start").alias("start"))
    lines = F.size(F.split("text", "\n"))
    held = held.withColumns({"hits": contact_lines(F.col("text")), "lines": lines})
    held = held.withColumns({"contact": 2 * F.col("hits") > F.col("lines"), "end": F.col("start") + F.char_length("text")})
    df = held.join(heads, ["doc_id", "s"], "full")
    section = Window.partitionBy("doc_id", "s")
    loose, any_hit = F.col("heading").isNull(), F.max(F.coalesce(F.col("hits"), F.lit(0)) > 0).over(section)
    of_loose = F.when(~F.col("headed"), "other").when(any_hit, "contact").otherwise("summary")
    df = df.withColumns({
        "types": F.when(loose, F.array(of_loose)).otherwise(F.col("types")),
        "source": F.when(loose, F.when(of_loose == "contact", "pattern").otherwise("fallback")).otherwise(F.col("source")),
        "confidence": F.when(loose, F.when(of_loose == "contact", "high").otherwise("low")).otherwise(F.col("confidence")),
        "last": F.coalesce(F.max(F.when(~F.col("contact"), F.col("i"))).over(section), F.lit(-1)),
        "marked": F.coalesce(F.bool_or("contact").over(section), F.lit(False)),
        "ends": F.coalesce(F.max_by("contact", "i").over(section), F.lit(False)),
    })
    open_ = ~F.array_contains("types", "contact")
    cut = open_ & F.col("ends") & (F.col("last") >= 0)
    df = df.withColumns({"part": (cut & (F.col("i") > F.col("last"))).cast("int"), "tagged": open_ & F.col("marked") & ~cut})
    out = df.groupBy("doc_id", "s", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "text", "start")))).alias("b"),
        *(F.first(c).alias(c) for c in ("heading", "types", "source", "confidence", "heading_end", "tagged")), F.min("start").alias("content_start"), F.max("end").alias("end"),
    )
    split_off = F.col("part") == 1
    types = F.when(split_off, F.array(F.lit("contact"))).when(F.col("tagged"), F.concat("types", F.array(F.lit("contact")))).otherwise(F.col("types"))
    return out.select(
        "doc_id", (F.row_number().over(doc.orderBy("s", "part")) - 1).alias("n"), types.alias("types"), F.when(~split_off, F.col("heading")).alias("heading"),
        F.coalesce("content_start", "heading_end").alias("content_start"), F.coalesce("end", "heading_end").alias("end"),
        F.when(split_off, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(split_off, "pattern").otherwise(F.col("source")).alias("source"),
        F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"))).alias("blocks"),
    )


def section_warnings(blocks: DataFrame) -> DataFrame:
    """(doc_id, warning): no_headings, style_skipped (one heading says nothing of a style), style_guard."""
    df = with_headings(blocks).groupBy("doc_id").agg(F.count("kind").alias("n"), F.max("n_known").alias("known"), F.bool_or("guarded").alias("guarded"))
    codes = F.array_compact(F.array(F.when(F.col("known") == 1, F.lit("style_skipped")), F.when(F.col("guarded"), F.lit("style_guard")), F.when(F.col("n") == 0, F.lit("no_headings"))))
    return df.select("doc_id", F.explode(codes).alias("warning"))
