"""Duplicate postings: one employer, one role, one place, near-equal text.

The title key keeps what stands in brackets, so a level or team there tells openings apart, and location is part of the
key.  Within such an opening two postings are the same if their five-word shingles are similar to 0.8 or more, or if one
is marked as cut short and 0.8 of it stand in a complete one; whatever connects through such pairs is one group.  Anything
less certain is left alone, an empty text included.

Keys are worked out once per posting and stored, as are its words: all that is stored or sent of the texts, but for those that
are compared.  Equal words are one text, however often posted, and only openings with several texts are compared.  The pick is an
aggregate and the verdict is joined back by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhire.functions.text import collapse, company_key, opening_key
from tallyhire.operators.settle import settled
from tallyhire.operators.similar import same_texts
from tallyhire.operators.skew import spread_join

OPENING = ["company_key", "title_key", "location_key"]


def with_keys(jobs: DataFrame) -> DataFrame:
    """Add the keys of the opening and the text's words; rows lacking a company, a title or a text get NULL keys."""
    ck = company_key(F.coalesce("company", F.lit("")))
    tk = opening_key(F.coalesce("title", F.lit("")))
    words = opening_key(F.coalesce("description", F.lit("")))
    known = (ck != "") & (tk != "") & (words != "")
    return jobs.withColumns({
        "company_key": F.when(known, ck),
        "title_key": F.when(known, tk),
        "location_key": F.when(known, F.lower(collapse(F.coalesce("location", F.lit(""))))),
        "words": F.when(known, words),
    })


def text_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From stored rows (row, id, block, node, words, complete, chars): each text with its group's root, and each group's pick.

    The pick has the most complete description, then the longest, then the lowest id.  A text goes by its first row.
    """
    # min over a struct: incomplete sorts after complete, short after long
    order = F.struct((~F.col("complete")).alias("a"), (-F.col("chars")).alias("b"), F.col("id").alias("c"))
    classes = settled(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("block").alias("block"), F.min(order).alias("best"), F.count("*").alias("copies"),
        F.max("complete").alias("complete"), F.min("row").alias("text")))
    several = classes.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    met = settled(spread_join(classes.select("text", "block", "complete"), several, ["block"], ["text"], weight="n").where(
        F.col("n").isNotNull()).select(F.col("text").alias("node"), "complete"))
    roots = same_texts(met, rows.where(F.col("node").isNotNull()).select(F.col("row").alias("node"), "block", "complete", "words"))
    grouped = settled(classes.select("node", "text", "best", "copies").join(
        roots.withColumnRenamed("node", "text"), "text", "left").withColumn("root", F.coalesce("root", "text")))
    picks = grouped.groupBy("root").agg(
        F.min("best").alias("best"), F.sum("copies").alias("copies"), F.count("*").alias("texts")).where("copies > 1").select(
        "root", F.col("best.c").alias("canonical"), "copies", "texts")
    return grouped.select("node", "root", "copies"), picks


def opening_rows(jobs: DataFrame) -> DataFrame:
    """(row, id, block, node, words, complete, chars), stored; ``node`` is NULL for rows that stay on their own."""
    block = F.concat_ws("\n", *OPENING)
    node = F.when(F.col("words").isNotNull(), F.unhex(F.sha1(F.concat_ws("\n", *OPENING, "words"))))
    return settled(with_keys(jobs).select(
        F.monotonically_increasing_id().alias("row"), "id", F.xxhash64(block).alias("block"), node.alias("node"), "words",
        F.coalesce("description_complete", F.lit(False)).alias("complete"),
        F.length(F.coalesce("description", F.lit(""))).cast("long").alias("chars")), "zstd")


def canonical_picks(jobs: DataFrame) -> DataFrame:
    """(canonical, copies, texts): one row per group of more than one posting."""
    return text_groups(opening_rows(jobs))[1].drop("root")


def assign_canonical(jobs: DataFrame) -> DataFrame:
    """Jobs with ``canonical_id`` set on duplicates and NULL on canonical and single postings."""
    rows = opening_rows(jobs)
    texts, picks = text_groups(rows)
    answers = settled(texts.join(picks.select("root", "canonical"), "root").select("node", "copies", "canonical"))
    found = spread_join(rows.select("id", "node"), answers, ["node"], ["id"], weight="copies").where(
        F.col("canonical") != F.col("id")).select("id", "canonical").distinct()
    others = [c for c in jobs.columns if c != "canonical_id"]
    marked = jobs.select(*others).join(found, "id", "left").withColumn("canonical_id", F.col("canonical"))
    return marked.select(*jobs.columns)


def repost_counts(jobs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, repost_count): postings with the same company and title, the row itself included.

    ``only`` names the postings to answer for; all are counted, and just these meet the counts.
    """
    pair = ["company", "title"]
    known = [F.coalesce(c, F.lit("")).alias(c) for c in pair]
    base = (jobs if only is None else only).select("id", *known)
    counts = jobs.select(*known).groupBy(*pair).agg(F.count("*").alias("repost_count"))
    return spread_join(base, counts, pair, ["id"], weight="repost_count").select(
        "id", F.greatest("repost_count", F.lit(1)).alias("repost_count")
    )
