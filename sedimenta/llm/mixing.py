"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal blocks of words.

Targets come from weights with a cap on repeats. Their words are counted in blocks; seats (blocks)
go to the sources with the highest quotients target / (2 * seats + 1), and each source's seats to
its shards in the same way, so quotas are integers that add up. In a shard documents lie in a seeded
order, end to end; a seeded permutation of its blocks says which are taken once more than the rest.

Everything is DataFrame functions over (id, source, size): texts are only counted, and hashed where
whole documents are taken. A source is dealt into shards by a hash, as many as its documents ask for,
so a large one isn't in one task. Sources themselves, a row each, are ranked in one task: up to some millions
of them are meant. Whole documents are taken by rounding the running sum of their shares
through each shard, largest first; smaller ones then make up for what that leaves over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources.hfs import stage_table

#: A prime above any shard's number of blocks, so that multiplying by it permutes them.
_STRIDE = 2147483647


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _number(text: Column) -> Column:
    """32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _label(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def apportion(items: DataFrame, parent: list[str], order: list) -> DataFrame:
    """``items`` (with weight, most, and the parent's seats) and ``quota``: seats by highest quotients.

    An item gets at most ``most`` seats. Only the seats about an item's fair share are ranked: those below
    are sure to be won, since the divisor can't be off by more than items / (2 * seats).
    """
    whole = Window.partitionBy(*parent)
    share = F.col("seats") * F.col("weight") / F.col("all_weight")
    half = F.ceil(share * F.col("n") / (2 * F.col("seats"))) + 2
    fair = items.withColumns({"all_weight": F.sum("weight").over(whole), "n": F.count("*").over(whole)}).withColumns({"share": F.when((F.col("seats") > 0) & (F.col("all_weight") > 0), share).otherwise(0.0), "half": F.when((F.col("seats") > 0) & (F.col("all_weight") > 0), half).otherwise(0)})
    sure = F.least(F.col("most"), F.greatest(F.lit(0), F.floor("share") - F.col("half")))
    last = F.least(F.col("most"), F.floor("share") + F.col("half"))
    fair = fair.withColumns({"sure": sure.cast("long"), "last": last.cast("long")}).withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    seats = fair.withColumn("k", F.explode_outer(F.when(F.col("last") > F.col("sure"), F.sequence(F.col("sure"), F.col("last") - 1))))
    quotient = F.when(F.col("weight") > 0, F.col("weight") / (2 * F.col("k") + 1))
    ranked = seats.withColumn("q", quotient).withColumn("won", F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc_nulls_last("q"), *order)))
    won = F.sum(F.when(F.col("q").isNotNull() & (F.col("won") <= F.col("open")), 1).otherwise(0))
    keep = [c for c in items.columns]
    return ranked.groupBy(*keep).agg((F.max("sure") + won).cast("long").alias("quota"))


def taken(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 32, shard_docs: int = 8192, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", places: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; with ``places`` also (label, shard, key, text_hash).

    Sources by code point, null last and a source of its own, weigh ``weights`` in turn. They share ``share``
    times all words; no target is above ``cap`` times its source's words, the excess goes to the others by
    weight. ``taken`` counts the words the mix takes of a row, repeats too: at most ``cap`` (a whole number)
    times its size. A null or wordless text has size 0 and gives 0. Rows with one id and size take places
    next to each other. Reruns agree. An empty table gives no rows.
    """
    more = [F.xxhash64(text_col).alias("text_hash")] if places else []
    sized, _ = stage_table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"), *more), "sizes")
    # One row a source from here to the shards.
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    all_words = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("src")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"place": place, "w": weight, "most_words": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(all_words) * F.lit(float(share))})
    # Capped sources are those that fill first, by words a unit of weight.
    filling = Window.orderBy(F.col("most_words") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sum("w").over(all_words) - F.sum("w").over(filling) + F.col("w")
    sources = sources.withColumn("level", (F.col("total") - (F.sum("most_words").over(filling) - F.col("most_words"))) / rest)
    free = F.when(F.col("most_words") / F.col("w") > F.col("level"), F.struct(F.col("most_words") / F.col("w"), F.col("place"), F.col("level").alias("level")))
    level = F.min(free).over(all_words)["level"]
    sources = sources.withColumn("target", F.coalesce(F.least("most_words", level * F.col("w")), F.col("most_words")))
    sources = sources.withColumn("shards", F.ceil(F.col("docs") / F.lit(shard_docs)).cast("long"))
    # A source's label stands for it from here, as null can't be joined on.
    label = _label(F.col("src"))
    sources, _ = stage_table(sources.select(label.alias("label"), "place", "source_size", "target", "shards", F.lit(0).alias("one")), "sources")
    dealt = sized.withColumn("label", label).drop("src").join(sources.select("label", "source_size", "target", "shards"), "label")
    dealt = dealt.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("shards")))
    per_shard = dealt.groupBy("label", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    per_shard, _ = stage_table(per_shard, "shards")
    most = per_shard.groupBy("label").agg((F.sum("blocks") * F.lit(int(cap))).alias("most"))
    seats = sources.join(most, "label").withColumns({"weight": F.col("target"), "seats": F.round(F.sum("target").over(Window.partitionBy("one")) / F.lit(block)).cast("long")})
    quotas = apportion(seats.select("label", "one", "place", "weight", "most", "seats"), ["one"], ["place", "k"]).select("label", F.col("quota").alias("seats"))
    shards = per_shard.join(quotas, "label").withColumns({"weight": F.col("words").cast("double"), "most": F.col("blocks") * F.lit(int(cap))})
    quotas = apportion(shards.select("label", "shard", "blocks", "weight", "most", "seats"), ["label"], ["shard", "k"]).select("label", "shard", "blocks", "quota")
    quotas = quotas.withColumn("first", F.pmod(_number(F.concat(F.lit(f"{seed}:"), F.col("label"), F.lit(":"), F.col("shard").cast("string"))), F.greatest(F.col("blocks"), F.lit(1))))
    order = Window.partitionBy("label", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lying = dealt.withColumn("start", F.sum("size").over(order) - F.col("size")).join(quotas, ["label", "shard"])
    b = F.lit(block)
    extra = F.aggregate(
        F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.when(F.pmod(k * F.lit(_STRIDE) + F.col("first"), F.col("blocks")) < F.pmod(F.col("quota"), F.col("blocks")), F.least(F.col("start") + F.col("size"), (k + 1) * b) - F.greatest(F.col("start"), k * b)).otherwise(F.lit(0).cast("long")),
    )
    words = F.when(F.col("size") > 0, F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + extra).otherwise(F.lit(0).cast("long"))
    return lying.select(F.col("id").alias(id_col), "size", "source_size", "target", words.cast("long").alias("taken"), *(["label", "shard", "key", "text_hash"] if places else []))


def _whole_copies(rows: DataFrame, most: int, passes: int = 4) -> DataFrame:
    """``rows`` (of :func:`taken` with its places) and ``copies``, 0 to ``most``, whose words come to what is taken of each shard.

    The running sum of taken / size is rounded, largest rows first, so a shard is off by half its largest row
    at most. Each pass then gives or takes one copy of the largest rows that fit in what is left over.
    """
    shard = Window.partitionBy("label", "shard")
    order = shard.orderBy(F.desc("size"), "key", "id", "text_hash", "taken")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.floor(F.sum(F.col("taken") / F.col("size")).over(upto) + 0.5))
    rows = rows.withColumn("copies", F.least(F.lit(most), F.greatest(F.lit(0), F.col("sum") - F.coalesce(F.lag("sum").over(order), F.lit(0)))).cast("int"))
    for _ in range(passes):
        rows = rows.withColumn("left", F.sum(F.col("taken") - F.col("copies") * F.col("size")).over(shard))
        fits = (F.col("size") <= F.abs("left")) & F.when(F.col("left") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        rows = rows.withColumn("fits", fits).withColumn("run", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(upto))
        more = F.when(F.col("fits") & (F.col("run") <= F.abs("left")), F.signum("left")).otherwise(0)
        rows = rows.withColumn("copies", F.col("copies") + more.cast("int"))
    return rows.drop("sum", "left", "fits", "run")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 2.0, **options) -> DataFrame:
    """``docs`` as the mix takes them, in their own columns: whole rows, 0 to ``cap`` times, with the words of each shard's quota.

    What rounding leaves over goes to smaller rows of the same shard, so a shard misses its quota by about a
    small row. Rows with one id, source and text share their copies evenly. Wordless rows go.
    """
    rows = taken(docs, cap=cap, id_col=id_col, text_col=text_col, source_col=source_col, places=True, **options).where("size > 0")
    rows = rows.select(F.col(id_col).alias("id"), "label", "shard", "key", "size", "text_hash", "taken")
    rounded = _whole_copies(rows, int(cap))
    groups = rounded.groupBy(F.col("id").alias("mix_id"), F.col("label").alias("mix_label"), F.col("size").alias("mix_size"), F.col("text_hash").alias("mix_hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    groups = groups.where("copies > 0").select("mix_id", "mix_label", "mix_size", "mix_hash", F.expr("copies div n").cast("int").alias("mix_copies"), (F.col("copies") % F.col("n")).alias("mix_more"))
    groups, _ = stage_table(groups, "copies")

    def of(some: DataFrame) -> DataFrame:
        some = some.hint("shuffle_hash")
        same = docs[id_col].cast("long").eqNullSafe(some["mix_id"]) & (_label(docs[source_col]) == some["mix_label"])
        return docs.join(some, same & (word_count(docs[text_col]) == some["mix_size"]) & (F.xxhash64(docs[text_col]) == some["mix_hash"]))

    def repeated(both: DataFrame, copies: Column) -> DataFrame:
        return both.withColumn("_mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])

    found = repeated(of(groups.where("mix_more = 0")), F.col("mix_copies"))
    if groups.where("mix_more > 0").isEmpty():
        return found
    # Equal rows that don't all have the same copies: the first of them have one more.
    alike = Window.partitionBy("mix_id", "mix_label", "mix_size", "mix_hash").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    uneven = of(groups.where("mix_more > 0")).withColumn("_mix_row", F.row_number().over(alike))
    return found.unionByName(repeated(uneven, F.col("mix_copies") + (F.col("_mix_row") <= F.col("mix_more")).cast("int")))
