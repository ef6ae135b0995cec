"""From a report's text blocks to sentences under headings, and to claims.

Blocks have doc, page, ord (reading order), text, size and bold, as a PDF
extractor gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.slots import drop_reason, material, with_slots
from ..functions.text import join_lines, sentences, squeeze, without_footnote_mark
from .common import once

#: A text on at least this share of pages is a running header or footer.
REPEATED_SHARE = 0.30
#: A block this much larger than its page's median font is a heading (of the first level, if larger still), if it has few words.
HEADING_RATIO, FIRST_LEVEL_RATIO, HEADING_WORDS = 1.15, 1.45, 12


def without_boilerplate(blocks: DataFrame, share: float = REPEATED_SHARE, doc: str = "doc", page: str = "page") -> DataFrame:
    """Drops blocks whose text is on max(2, share of pages) pages or more, and those of the smallest of three or more font sizes."""
    low = F.lower("text")
    repeated = blocks.groupBy(F.col(doc).alias("_doc"), low.alias("_low")).agg(F.count_distinct(page).alias("_pages"))
    whole = blocks.groupBy(F.col(doc).alias("_doc")).agg(F.count_distinct(page).alias("_n"), F.min(F.bround("size", 1)).alias("_least"), F.count_distinct(F.bround("size", 1)).alias("_tiers"))
    repeated = repeated.join(whole.select("_doc", "_n"), "_doc").where(F.col("_pages") >= F.greatest(F.lit(2), F.floor(F.col("_n") * share)))
    out = blocks.join(repeated.select("_doc", "_low"), (blocks[doc] == F.col("_doc")) & (F.lower(blocks["text"]) == F.col("_low")), "left_anti")
    out = out.join(whole, out[doc] == whole["_doc"])
    return out.where(~((F.col("_tiers") >= 3) & (F.bround("size", 1) == F.col("_least")))).select(*blocks.columns)


def is_heading_text(text):
    """Two or more words with letters, few with digits, and no percent sign."""
    w = F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")
    digits = F.size(F.filter(w, lambda x: x.rlike(r"\p{Nd}")))
    return (F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) >= 2) & (digits < F.greatest(F.lit(2.0), F.size(w) / 3)) & ~F.contains(text, F.lit("%"))


def heading_level(text, size, bold, median):
    """1 or 2 for a heading (1: much larger than the page's text), else null."""
    short = F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")) <= HEADING_WORDS
    heading = short & ((size >= median * HEADING_RATIO) | bold) & ~F.endswith(text, F.lit(".")) & is_heading_text(text)
    return F.when(heading, F.when(size >= median * FIRST_LEVEL_RATIO, 1).otherwise(2))


def with_sections(blocks: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """``blocks`` with level (1 or 2 for headings) and section_path: the last first-level heading, > and the last second-level one under it."""
    median = F.median("size").over(Window.partitionBy(doc, page))
    level = heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("_median"))
    order = Window.partitionBy(doc).orderBy(page, "ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("_median", median).withColumn("level", level)
    out = out.withColumn("_h1", F.last(F.when(F.col("level") == 1, F.col("text")), True).over(so_far)).withColumn("_part", F.sum((F.col("level") == 1).cast("int")).over(so_far))
    under = Window.partitionBy(doc, "_part").orderBy(page, "ord").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_h2", F.last(F.when(F.col("level") == 2, F.col("text")), True).over(under))
    return out.withColumn("section_path", F.concat_ws(" > ", "_h1", "_h2")).drop("_median", "_h1", "_h2", "_part")


def page_texts(blocks: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """doc, page, page_text: a page's blocks joined in reading order, as one line."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"])
    return blocks.groupBy(doc, page).agg(squeeze(join_lines(lines)).alias("page_text"))


def tagged_sentences(blocks: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Every sentence of every block that is no heading, with drop_reason (null: a claim), slots, and its section."""
    pages = page_texts(blocks)
    body = with_sections(without_boilerplate(blocks)).where("level is null")
    found = F.transform(sentences(F.col("text")), squeeze)
    out = body.select("doc", "page", "ord", "section_path", F.posexplode(found).alias("n", "sentence"))

    def read(t: DataFrame) -> DataFrame:
        # a footnote's mark stays in the evidence, but its number is no quantity
        t = with_slots(t.withColumn("_dropped", drop_reason(F.col("sentence"), lexicon)).withColumn("_body", without_footnote_mark(F.col("sentence"))), lexicon, "_body")
        return t.withColumn("_material", material(F.col("_body"), F.col("claim_type"), F.col("quantity"), lexicon)).drop("_body")

    columns = out.columns
    out = once(out, "sentence", read, blocks.select("text").distinct().select(F.explode(found).alias("sentence"))).join(pages, ["doc", "page"], "left")
    # evidence is literal: what is not on its own page word for word is no evidence
    astray = F.col("_dropped").isNull() & ~F.coalesce(F.contains("page_text", "sentence"), F.lit(False))
    reason = F.when(astray, "not verbatim").when(F.col("_dropped").isNull() & ~F.col("_material"), "not material").otherwise(F.col("_dropped"))
    return out.select(*columns, reason.alias("drop_reason"), *(c for c in out.columns if c not in (*columns, "page_text", "_dropped", "_material")))


def claims(blocks: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """The claims of reports, one row for each sentence kept."""
    return tagged_sentences(blocks, lexicon).where("drop_reason is null").drop("drop_reason", "ord", "n")


def funnel(tagged: DataFrame) -> DataFrame:
    """How many sentences of each document were kept, or dropped and why."""
    return tagged.groupBy("doc", F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def empty_pages(pages: DataFrame) -> DataFrame:
    """doc and the ordered list of its pages without text."""
    return pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(F.coalesce(F.trim("page_text"), F.lit("")) == "", F.col("page")))).alias("pages"))
