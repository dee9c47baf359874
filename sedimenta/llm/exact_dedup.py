"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its content says so (after a sentence or line end that follows enough
characters), so equal texts have equal chunks. Each chunk gets a 64-bit identifier, which is
verified over all documents: chunks are deduplicated by identifier and SHA-256, and where two
digests share an identifier the digest becomes part of it. A document is then its ordered list
of identifiers, under one hundredth of its text; groups are equal lists. Texts are read where
they lie and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.sources.hfs import stage_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z, and only those, in lower case; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: Column, least: int, most: int) -> Column:
    """The text's content-defined chunks, in order; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 2}}}?(?:[.!?][ \n]|\n)|.{{1,{most}}}"), F.lit(0))


def decisions(docs: DataFrame, least: int = 512, most: int = 8192, id_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Texts are equal when they are so after lower-casing A-Z; null is empty. Of equal texts the largest id
    stays (null ids are the smallest). Rows that repeat an id and its text share its decision and count in
    group_size. An empty table gives no rows. ``id_bits`` shortens identifiers, to test the verification.
    """
    text = folded(F.col(text_col))
    short = (lambda c: F.xxhash64(c)) if id_bits >= 64 else (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << id_bits)))
    parts = F.transform(chunks(F.col("t"), least, most), lambda c: F.struct(short(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("d")))
    lists, _ = stage_table(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select("id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), parts.alias("parts")), "recipes")
    # Distinct chunks; an identifier that two of them share needs the digest beside it.
    clash = lists.select(F.explode("parts").alias("p")).select("p.h", "p.d").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    clash, _ = stage_table(clash, "clashes")
    recipe = F.transform("parts", lambda p: p["h"])
    if clash.isEmpty():
        rows = lists.select("id", "sha", recipe.alias("recipe"), F.array().cast("array<binary>").alias("more"))
    else:
        own = lists.select("sha", "parts").dropDuplicates(["sha"]).select("sha", F.posexplode("parts").alias("pos", "p"))
        more = own.select("sha", "pos", "p.h", "p.d").join(clash, "h", "left_semi").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("x"))
        more = more.select("sha", F.transform("x", lambda x: x["d"]).alias("more"))
        rows = lists.join(more, "sha", "left").select("id", "sha", recipe.alias("recipe"), F.coalesce("more", F.array().cast("array<binary>")).alias("more"))
    groups = rows.groupBy("recipe", "more").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    both = rows.join(groups, ["recipe", "more"])
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns; of rows that repeat the kept id and text, one stays."""
    kept, _ = stage_table(decisions(docs, id_col=id_col, text_col=text_col, **options).where("kept").groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(F.count("*").alias("n")), "kept")
    sha = F.sha2(folded(docs[text_col]).cast("binary"), 256)

    def rows(some):
        # The few identifiers are hashed, so that the texts aren't sorted.
        return docs.join(some.hint("shuffle_hash"), docs[id_col].cast("long").eqNullSafe(some["kept_id"]) & (sha == some["kept_sha"]), "left_semi")

    once = rows(kept.where("n = 1"))
    if kept.where("n > 1").isEmpty():
        return once
    return once.unionAll(rows(kept.where("n > 1")).withColumn("_kept_sha", F.sha2(folded(F.col(text_col)).cast("binary"), 256)).dropDuplicates([id_col, "_kept_sha"]).drop("_kept_sha"))
