"""Exact duplicates by block naming: equal blocks get equal integers, then adjacent pairs of integers do.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and numbered; the number is the block's name. Neighbouring names are paired, the
distinct pairs are sorted and numbered again, until one name is left. Two texts
of the same number of blocks have the same last name exactly when they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import ascii_lower
from trailmark.operators.ordering import dense_index
from trailmark.storage import materialise

BLOCK_BYTES = 4096


def block_order(block: Column, seed: int) -> list[Column]:
    """The leading sort columns of a block; its bytes come last in the order."""
    return [F.xxhash64(F.lit(2 * seed), block).alias("_a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("_b")]


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.col("_blocks") - 1)
    cut = F.transform(starts, lambda i: F.struct(i.alias("_at"), F.substring(F.col("_body"), i * block_bytes + 1, F.lit(block_bytes)).alias("_block")))
    return rows.select(*(c for c in rows.columns if c != "_body"), F.explode(cut).alias("_cut")).select("*", "_cut._at", "_cut._block").drop("_cut")


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, order=block_order) -> DataFrame:
    """One row per document with the identity of its A-Z lower-cased text.

    Blocks are sorted by two 64-bit hashes and then by their bytes. The bytes of
    all distinct blocks are shuffled once, combined on the map side, to see
    that no two of them share both hashes; from then on the hashes alone place
    a block in the order. Should two share them, all is redone with other
    hashes, so that names are free of collisions in any case.

    Returns _row, doc_id, text_sha256, _blocks, _name; (_blocks, _name) is the identity.
    """
    body = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), body.alias("_body"))
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("_body") / block_bytes)).cast("int"))
    for seed in range(8):
        hashes = order(F.col("_block"), seed)
        distinct = _blocks(rows.select("_body", "_blocks"), block_bytes).select(*hashes, "_block").groupBy("_a", "_b", "_block").agg(F.lit(1).alias("_one"))
        keys = materialise(distinct.select("_a", "_b"), "blocks")
        if keys.count() == keys.distinct().count():
            break
    else:
        raise RuntimeError("two different blocks share both hashes under every seed")
    named = dense_index(keys, ["_a", "_b"], "_name")
    digest = F.sha2("_body", 256).alias("text_sha256")
    cut = _blocks(rows.select("_row", "doc_id", "_blocks", digest, "_body"), block_bytes)
    sha = F.when(F.col("_at") == 0, F.col("text_sha256")).alias("text_sha256")
    cut = materialise(cut.select("_row", "doc_id", "_blocks", sha, "_at", *hashes), "cut")
    heads = cut.filter("_at = 0").select("_row", "doc_id", "text_sha256")
    level = materialise(cut.join(named, ["_a", "_b"]).select("_row", "_blocks", "_at", "_name"), "named")

    ready = []
    width = level.agg(F.max("_blocks")).first()[0] or 1
    left = F.col("_blocks")  # names a document has at this level
    while True:
        ready.append(level.filter(left == 1).select("_row", "_blocks", "_name"))
        if width == 1:
            break
        pairs = level.filter(left > 1).groupBy("_row", "_blocks", F.shiftright("_at", 1).alias("_at")).agg(
            F.max(F.when(F.col("_at") % 2 == 0, F.col("_name"))).alias("_left"),
            F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_right"),
        )
        pairs = materialise(pairs, "pairs")
        named = dense_index(pairs.select("_left", "_right").distinct(), ["_left", "_right"], "_name")
        level = materialise(pairs.join(named, ["_left", "_right"]).select("_row", "_blocks", "_at", "_name"), "named")
        width, left = (width + 1) // 2, F.shiftright(left + 1, 1)
    names = ready[0]
    for more in ready[1:]:
        names = names.unionByName(more)
    return materialise(heads.join(names, "_row"), "identities")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, order=block_order) -> DataFrame:
    """Every document with the group of equal texts it belongs to.

    Texts are equal when they agree after lower-casing A-Z; null counts as
    empty. Of a group the row with the largest id stays (null ids are smallest),
    of repeated rows with that id just one. Returns one row per row of ``docs``:
    doc_id, keep_id, group_size, kept, text_sha256. Other columns are ignored;
    no rows give no rows.
    """
    named = document_names(docs, id_col, text_col, block_bytes, order)
    best = F.max(F.struct("doc_id", (-F.col("_row")).alias("_row")))
    groups = named.groupBy("_blocks", "_name").agg(best.alias("_best"), F.count("*").alias("group_size"))
    # stored, so that both sides of the join are shuffles and a hot group can be split
    joined = named.join(materialise(groups, "groups"), ["_blocks", "_name"])
    return joined.select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == -F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that :func:`duplicate_groups` keeps, with all their columns.

    Rows are found again by id and text digest. Only where several rows share
    both are they numbered to keep one.
    """
    rows = duplicate_groups(docs, id_col, text_col, block_bytes)
    same = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
    kept = materialise(same.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), "copies"), "kept")
    # the row travels as one column, so that its columns may have any names
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), digest.alias("sha"))
    match = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    if kept.filter("copies > 1").isEmpty():
        return whole.join(kept, match, "left_semi").select("row.*")
    found = whole.join(kept, match)
    number = F.row_number().over(Window.partitionBy("kept_id", "kept_sha").orderBy(F.xxhash64("row")))
    once = found.filter("copies > 1").withColumn("number", number).filter("number = 1")
    return found.filter("copies = 1").select("row.*").unionByName(once.select("row.*"))
