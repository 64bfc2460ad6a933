"""Documents to blocks to sentences: normalization, block types, sections, noise and context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import SPACE, free, is_upper, nfc, once, re_, strip

_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
MIN_SENTENCE = 10

# What makes a sentence noise.
NOISE = (
    r"<!\-\-\s*image\s*\-\->",
    r"^\s*(trang|page)\s*\d+\s*$",
    r"^[•\-\*\+]{1,3}\s*$",
    r"^[\d\.\s]+$",
    r"^(\.{3,}|…+|\-{3,}|_{3,}|\*{3,})$",
    r"^\d{1,3}$",
)
# Units that make a block one of figures.
KPI_WORDS = r"%|tỷ|triệu|nghìn|tấn|kg|CO2|Scope|KPI"


def normalize(c: Column, compose: bool = True) -> Column:
    """NFC, plain spaces and dots, single spaces, at most one blank line, no space around."""
    c = nfc(c) if compose else c
    c = F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("…"), F.lit("."))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def blocks_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"\n{SPACE}*\n"), strip), lambda b: b != "")


def is_md_heading(c: Column) -> Column:
    return F.split(strip(c), "\n")[0].rlike(r"(?U)^#{1,6}\s+")


def clean_heading(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"(?Umd)^#{1,6}\s+", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s*\n\s*", " "), ":+$", ""))


def is_meta_heading(c: Column) -> Column:
    return c.rlike(r"^[A-Z]\p{Nd}{2}[/\-][A-Z0-9\-]+\n?$")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, _BREAK), strip), lambda x: x != "")


def is_table_like(c: Column) -> Column:
    def table(lines):
        n = F.size(lines)
        pipes = F.size(F.filter(lines, lambda x: x.contains("|")))
        columns = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S\s{2,}\S")))
        return (n >= 3) & ((pipes / n >= 0.5) | (columns / n >= F.lit(0.6)))

    return once(_lines(c), table)


def is_bullet_like(c: Column) -> Column:
    lines = _lines(c)
    marks = F.size(F.filter(F.transform(F.filter(F.split(c, _BREAK), lambda x: strip(x) != ""), lambda x: F.regexp_replace(x, r"(?U)^\s+", "")), lambda x: x.rlike(r"(?U)^(\-|•|♦|\+)\s+")))
    return (F.size(lines) >= 2) & (marks / F.size(lines) >= 0.5)


def block_type(c: Column) -> Column:
    def body(c):
        return F.when(is_table_like(c), "table_like").when(is_bullet_like(c), "bullet_like").when(c.rlike(re_(KPI_WORDS)) & c.rlike(r"\p{Nd}"), "kpi_like").otherwise("paragraph")

    def kind(t):
        heading = is_md_heading(t) | ((F.length(t) < 90) & is_upper(t))
        return once(heading, lambda h: F.when(h & is_meta_heading(clean_heading(t)), "meta_heading").when(h, "heading_like").otherwise(body(c)))

    return once(strip(c), kind)


def is_heading(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) <= 120) & (is_upper(t) | (t.endswith(":") & (F.length(t) < 100)))


def sentences_of(c: Column) -> Column:
    """Pieces after . ? or ! and space."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)(?<=[.?!])\s+"), strip), lambda s: s != "")


def is_noise(c: Column) -> Column:
    def noise(s):
        out = (F.length(s) < 15) | ((F.length(s) < 80) & is_upper(s))
        for p in NOISE:
            out = out | s.rlike(re_(p))
        return out | (F.length(F.regexp_replace(s, r"\P{L}+", "")) / F.greatest(F.length(s), F.lit(1)) < F.lit(0.3))

    return once(strip(c), noise)


def with_neighbours(parts: Column) -> Column:
    """Each string of an array with the ones before and behind it ('' at the ends), to be exploded: rows that took them
    from the array would each hold a copy of all of it."""
    return once(parts, lambda p: F.transform(p, lambda s, i: F.struct(s.alias("it"), F.coalesce(F.get(p, i - 1), F.lit("")).alias("prev"), F.coalesce(F.get(p, i + 1), F.lit("")).alias("next"))))


def bank_year(path: Column) -> tuple[Column, Column, Column]:
    """(bank, year, stem) of .../<bank>/<stem>.txt; year is the first 19xx or 20xx in the stem, else 0."""
    bank, stem = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    year = F.coalesce(F.nullif(F.regexp_extract(stem, r"(19|20)\d{2}", 0), F.lit("")).cast("int"), F.lit(0))
    return bank, year, stem


def build_blocks(raw: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, bank, year, path, content) -> blocks.  A heading opens a section; a meta heading doesn't."""
    b = raw.select("*", F.posexplode(blocks_of(normalize(F.col("content"), compose))).alias("order_in_doc", "block_text"))
    b = b.withColumn("block_type", block_type(F.col("block_text")))
    so_far = W.partitionBy("doc_id").orderBy("order_in_doc").rowsBetween(W.unboundedPreceding, 0)
    opens = F.col("block_type") == "heading_like"
    section = F.sum(F.when(opens, 1).otherwise(0)).over(so_far)
    title = F.last(F.when(opens, clean_heading(F.col("block_text"))), ignorenulls=True).over(so_far)
    return b.select(
        "doc_id", "bank", "year",
        F.concat("doc_id", F.lit("_sec"), section.cast("string")).alias("section_id"),
        F.coalesce(title, F.lit("UNKNOWN")).alias("section_title"),
        F.concat("doc_id", F.lit("_b"), F.col("order_in_doc").cast("string")).alias("block_id"),
        "block_type", "block_text", "order_in_doc", F.col("path").alias("source_path"),
    )


def build_sentences(blocks: DataFrame, split: Callable[[Column], Column] = sentences_of) -> DataFrame:
    """Sentences that are long enough and no noise, with their neighbours in the block."""
    kept = F.filter(split(F.col("block_text")), lambda s: (F.length(s) >= MIN_SENTENCE) & ~is_noise(s))
    s = blocks.where("block_type NOT IN ('heading_like', 'meta_heading')")
    s = s.select("*", F.posexplode(with_neighbours(kept)).alias("sent_idx_in_block", "__s"))
    at = F.col("sent_idx_in_block")
    return s.select(
        "doc_id", "bank", "year", "section_id", "block_id",
        F.concat("doc_id", F.lit("_s"), F.col("order_in_doc").cast("string"), F.lit("_"), at.cast("string")).alias("sent_id"),
        "sent_idx_in_block", F.col("__s.it").alias("sentence"), F.col("__s.prev").alias("ctx_prev"), F.col("__s.next").alias("ctx_next"),
        "block_type", "section_title",
    )


def model_text(sentence: str = "sentence") -> Column:
    """Sentence with its neighbours, empty ones left out."""
    return F.concat_ws(" ", F.nullif("ctx_prev", F.lit("")), sentence, F.nullif("ctx_next", F.lit("")))


def prompt(last_label: str, last: Column) -> Column:
    """Text handed to an external labeler."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{label}]: "), c, F.lit("\n"))).otherwise("")
    return F.concat(
        line("Cau truoc", F.col("ctx_prev")), F.lit("[Cau can phan loai]: "), "sentence", F.lit("\n"), line("Cau sau", F.col("ctx_next")), F.lit(f"[{last_label}]: "), F.coalesce(last, F.lit(""))
    )


RANGES = 1000


def with_position(df: DataFrame, doc: str, *order: str, name: str = "sent_pos", by: tuple[str, ...] = ()) -> DataFrame:
    """A dense number from 0 in the order (doc, *order) within each ``by``, or in the whole frame; null ids come first.

    Documents are counted first; running sums go over one row a document, and rows are only ordered within their own
    document.  Without ``by`` the documents are dealt into up to ``RANGES`` ranges of the id, of any type, whose edges
    are ids that the driver picks by hash (one small job); edges only balance the work."""
    at_doc, at_doc2, at_k, at_base, *at_by = free([*df.columns, name], "doc", "doc2", "k", "base", *(f"by{i}" for i in range(len(by))))
    d = df.withColumn(at_doc, F.col(doc))
    counts = d.groupBy(*by, F.col(at_doc).alias("__doc")).agg(F.count("*").alias("__n"))
    if by:
        before = W.partitionBy(*by).orderBy("__doc").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:
        picked = counts.where("__doc IS NOT NULL").select("__doc").orderBy(F.xxhash64("__doc"), "__doc").limit(RANGES)
        edges = F.array(*(F.lit(r[0]) for r in sorted(picked.collect()))) if not picked.isEmpty() else F.array()
        place = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col("__doc"))), F.lit(0)) if not picked.isEmpty() else F.lit(0)
        counts = counts.withColumn("__range", F.when(F.col("__doc").isNull(), -1).otherwise(place))
        sums = counts.groupBy("__range").agg(F.sum("__n").alias("__m"))
        before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
        start = sums.select("__range", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
        within = W.partitionBy("__range").orderBy("__doc").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(start, "__range")
        counts = counts.withColumn("__base", F.col("__start") + F.col("__in"))
    base = counts.select(*(F.col(c).alias(n) for c, n in zip(by, at_by, strict=True)), F.col("__doc").alias(at_doc2), F.col("__base").alias(at_base))
    # The document is the only key of windows and join, so that rows are exchanged once; null ones come first and start at 0.
    number, first = F.row_number().over(W.partitionBy(at_doc).orderBy(*by, *order)), F.min(at_k).over(W.partitionBy(at_doc, *by))
    same = F.col(at_doc) == F.col(at_doc2)
    for n, c in zip(at_by, by, strict=True):
        same = same & F.coalesce(F.col(c) == F.col(n), F.col(c).isNull() & F.col(n).isNull())
    d = d.withColumn(at_k, number)
    d = (d.withColumn(at_k, F.col(at_k) - first) if by else d.withColumn(at_k, F.col(at_k) - 1)).join(base, same, "left")
    return d.withColumn(name, F.coalesce(F.col(at_base), F.lit(0)) + F.col(at_k)).drop(at_doc, at_doc2, at_k, at_base, *at_by)


def text_position(df: DataFrame, name: str = "sent_pos") -> DataFrame:
    """Sentences numbered in the order of their (bank, year)'s texts: document, block, place in the block.  The latter
    two are read from sent_id where the frame has no columns for them."""
    part = lambda k: F.regexp_extract("sent_id", r"_s(\d+)_(\d+)$", k).try_cast("long")
    block = F.col("order_in_doc") if "order_in_doc" in df.columns else part(1)
    place = F.col("sent_idx_in_block") if "sent_idx_in_block" in df.columns else part(2)
    doc = F.col("doc_id") if "doc_id" in df.columns else F.regexp_replace("sent_id", r"_s\d+_\d+$", "")
    own = free([*df.columns, name], "text", "block", "place")
    d = df.withColumns(dict(zip(own, (doc, block, place), strict=True)))
    return with_position(d, *own, "sent_id", name=name, by=("bank", "year")).drop(*own)
