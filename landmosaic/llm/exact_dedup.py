"""Exact dedup by content-defined chunk recipes, in Spark's own functions only.

A text is cut where its content says so (after a line end or a full stop, at least MIN and at most MAX characters after
the last cut), so equal passages give equal chunks wherever they stand. Each distinct chunk gets an identifier, verified
by comparing the bytes of all chunks that share it; a document is then the ordered list of its identifiers, and documents
are equal when their lists are. Chunks travel once, for the verification; afterwards only lists of longs do.

Nulls count as empty texts, and all empty texts are equal (their list is empty). Of equal texts the one with the largest
id stays; a null id counts as smaller than all others. Rows that share an id and a text count as so many rows; exact_groups
judges them alike, and drop_copies leaves one of them. An empty table gives an empty result. Extra columns are ignored. A very
long text is cut by one expression, in the memory of one row; nothing else holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, once, salted_totals, saved, without

MIN, MAX = 1024, 8192


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[\n.]|.{{1,{most}}}"), F.lit(0))


#: Identifiers to try in turn; the second is for a corpus in which the first one is not unique.
IDENTIFIERS = (lambda c: F.xxhash64(c).cast("string"), lambda c: F.sha2(c, 256))


def unverified(texts: DataFrame, identifier) -> int:
    """How many identifiers stand for chunks whose bytes differ."""
    pieces = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    known = pieces.groupBy(identifier(F.col("chunk")).alias("ident")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return known.where("lo <> hi").count()


def recipes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text_sha256 and the ordered list of verified chunk identifiers (recipe) of each normalised text."""
    texts = docs.select(F.col(id_col), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    for identifier in IDENTIFIERS:
        if not unverified(texts, identifier):
            break
    else:
        raise ValueError("no identifier tells all chunks apart")
    return texts.select(id_col, F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), identifier).alias("recipe"))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = saved(recipes(docs, text_col, id_col), "recipes")
    rows = salted_totals(rows, "recipe", id_col, {"keep_id": ("max", id_col), "group_size": ("count", "text_sha256")})
    return rows.select(id_col, "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts; all columns as they were. Rows are told apart by id (nulls match) and
    text; of those that share both, the one whose other columns come first as JSON stays."""
    rows = exact_groups(docs, text_col, id_col).groupBy(id_col, "text_sha256")
    marks = saved(rows.agg(F.bool_or("kept").alias("stays"), F.count("*").alias("copies")).where("NOT stays OR copies > 1"), "marks")
    key = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    left = without(docs, marks.where("NOT stays"), id_col, key, "text_sha256", sieve=False)
    return once(left, marks.where("stays"), id_col, key, "text_sha256", text_col)
