"""Near-equal texts: MinHash signatures of word shingles, bands, and similarity verified on whole sets, in Column code.

A text is the set of the hashes of its five-word runs.  The hash's upper bits name one of the signature's places and the
smallest hash of a place stands there; a place that no shingle falls into takes the value of the next one that has any.
Texts that agree in all values of a band meet in a bucket of their block.  Two sets of similarity 0.8 miss each other in
all bands with a probability of about 5e-8.

Texts are longer than anything else here and their sets are longer still, so neither is stored or sent but for texts that are
compared: whoever needs a set makes it again from the words, after a sieve of bounded size has dropped the others.

No bucket is turned into all its pairs.  Every text is first compared with the smallest of its bucket.  Those in a bucket that
still holds several components then meet by their rarest shingles: two similar sets lack a fifth of each other at most, so the
first shingle they share, rarest first, comes early in both.  A passage that many texts quote is common and makes no pairs.

A text that is known to be cut short also meets the complete ones of its block by the rarest of its shingles, and counts as the
same if enough of it is found there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhire.functions.text import let, once
from tallyhire.operators.graph import connected
from tallyhire.operators.settle import settled
from tallyhire.operators.skew import sifted, spread_join

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Hundredths of the union, or of a cut text, that two texts share at least.
SIMILAR = 80
#: The fewest shingles of a text that can be cut.
PROBES = 8
#: Shingles by which a cut text looks for its whole: all of most, the smallest of a longer one.
SAMPLE = 40
#: Of the sample of a longer one, which may lack a fifth in all, more than so many are missing with a probability of 1e-6.
MISSES = 21
#: Pairs of one text that are verified together.
PAIRS_PER_SALT = 256


def _run(w: Column, i: Column) -> Column:
    """Hash of the five words from ``i``; of fewer at the end."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE_WORDS)])


def _starts(w: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE_WORDS, F.lit(0)))


def shingle_hashes(words: Column) -> Column:
    """Distinct hashes of the runs of five words; of fewer words, of all of them."""
    return F.array_distinct(let(words, lambda w: F.transform(_starts(w), lambda i: _run(w, i))))


def _words(c: Column | str) -> Column:
    return F.split(c, " ")


def _place(h: Column) -> Column:
    return (F.shiftright(h, 57) + PLACES // 2).cast("int")


def signature(hashes: Column) -> Column:
    """The smallest hash of every place, from sorted hashes, which are sorted by place as well."""
    def heads(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_place(h) != _place(F.get(s, i - 1))))

    def filled(h: Column) -> Column:
        runs = F.transform(h, lambda v, i: F.array_repeat(
            v, _place(v) - F.coalesce(F.when(i > 0, _place(F.get(h, i - 1))), F.lit(-1))))
        rest = F.array_repeat(F.get(h, F.lit(0)), PLACES - 1 - _place(F.element_at(h, -1)))
        return F.concat(F.flatten(runs), rest)

    return let(let(hashes, heads), filled)


def bucket_keys(block: Column, hashes: Column) -> Column:
    """One key per band, different for different blocks and bands; the hashes are sorted."""
    return let(signature(hashes), lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(block, b, F.slice(s, b * ROWS + 1, ROWS))))


def _allowed(size: Column) -> Column:
    """Shingles of a set that a similar one may lack, or of a cut text its whole."""
    return F.floor((100 - SIMILAR) * size / 100)


def _close(a: Column, b: Column) -> Column:
    """Sizes that similar sets can have."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def same_text(a: Column, b: Column, cut: Column) -> Column:
    """Of two texts' words: similar enough or, if ``a`` is cut short, enough of it in a longer ``b``."""
    def decided(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda common: F.when(
            cut, (F.size(x) < F.size(y)) & (100 * common >= SIMILAR * F.size(x))).otherwise(
            100 * common >= SIMILAR * (F.size(x) + F.size(y) - common)))

    return let(shingle_hashes(_words(a)), lambda x: let(shingle_hashes(_words(b)), lambda y: decided(x, y)))


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The stored pairs (u, v, cut) whose texts are the same; a frequent u is sent once to each salt of its pairs."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    dealt = spread_join(pairs, salts, ["u"], ["v"], weight="salts").select(
        "u", "v", "cut", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"))

    def texts(end: str, name: str) -> DataFrame:
        of = words.select(F.col("node").alias(end), F.col("words").alias(name))
        return sifted(of, pairs, [end])

    left = salts.join(texts("u", "a"), "u").select("u", "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = dealt.join(texts("v", "b"), "v")
    return right.join(left, ["u", "salt"]).where(same_text(F.col("a"), F.col("b"), F.col("cut"))).select("u", "v")


def sketched(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Stored: (node, complete) with the number of shingles, the bucket keys and, of a cut text, the sample."""
    sets = once(sifted(words, texts, ["node"]), hashes=F.sort_array(shingle_hashes(_words("words"))))
    size = F.size("hashes")
    found = settled(sets.select("node", size.alias("size"), bucket_keys(F.col("block"), F.col("hashes")).alias("buckets"), "block",
                                F.when(~F.col("complete") & (size >= PROBES), F.slice("hashes", 1, SAMPLE)).alias("sample")))
    return settled(texts.join(found, "node"))


def cut_candidates(cut: DataFrame, shingles: DataFrame, whole: DataFrame) -> DataFrame:
    """(u, v, sure): cut texts and the complete ones of their block that hold enough of their sample.

    ``cut`` holds (u, block, size, sample) and ``shingles`` (node, block, h) of all texts of ``whole`` (node, size), maybe of
    others too.  A whole lacks few of the sample, so it holds one of the sample's rarest; only those make pairs.  A sample that
    is the whole cut text settles the matter.
    """
    keys = cut.select("u", "block", "size", F.explode("sample").alias("h"))
    hits = settled(sifted(shingles, keys, ["block", "h"]).select("node", F.xxhash64("block", "h").alias("key")).distinct())
    held = hits.groupBy("key").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("u").orderBy("n", "key")
    lacking = F.when(F.col("size") > SAMPLE, MISSES).otherwise(_allowed(F.col("size")))
    probes = spread_join(keys.select("u", "size", F.xxhash64("block", "h").alias("key")), held, ["key"], ["u"]).withColumn(
        "n", F.coalesce("n", F.lit(0))).withColumn("place", F.row_number().over(rarest)).where(
        (F.col("place") <= 1 + lacking) & (F.col("n") > 0)).select("u", "key")
    met = settled(probes.join(hits.withColumnRenamed("node", "v"), "key").select("u", "v").distinct())
    lists = hits.join(met.select(F.col("v").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("v")).agg(
        F.collect_list("key").alias("list")).join(whole.select(F.col("node").alias("v"), F.col("size").alias("longer")), "v")
    samples = cut.select("u", "size", F.transform("sample", lambda h: F.xxhash64("block", h)).alias("keys"))
    found = F.size(F.array_intersect("keys", "list"))
    return met.join(lists, "v").join(samples, "u").where(
        (F.col("size") < F.col("longer")) & (F.size("keys") - found <= lacking)).select(
        "u", "v", (F.col("size") <= SAMPLE).alias("sure"))


def cut_pairs(texts: DataFrame) -> DataFrame:
    """``cut_candidates`` of texts (node, block, text struct(complete, hashes)) whose sets are at hand."""
    sets = texts.select("node", "block", "text.complete", F.sort_array("text.hashes").alias("hashes"), F.size("text.hashes").alias("size"))
    cut = sets.where(~F.col("complete") & (F.col("size") >= PROBES)).select(
        F.col("node").alias("u"), "block", "size", F.slice("hashes", 1, SAMPLE).alias("sample"))
    whole = sets.where("complete")
    return cut_candidates(cut, whole.select("node", "block", F.explode("hashes").alias("h")), whole).select("u", "v")


def rare_pairs(opened: DataFrame, words: DataFrame) -> DataFrame:
    """(u, v): texts of different labels, of (node, size, label), that share one of the rarest shingles of either.

    A shingle that only one label has is in none of these pairs, and as few may be lacking, a text with too many of them is out.
    The others are put in one order, rare before common, and each text keeps as many of its first as leave it no way around.
    Behind the first one that two texts share, each must have enough left for what they share in all.
    """
    sets = sifted(words, opened, ["node"]).select("node", "block", "words").join(opened, "node")
    # an outer generator: else the optimizer copies the array into a filter on its size
    rows = settled(sets.select("node", "size", "label", "block", F.explode_outer(shingle_hashes(_words("words"))).alias("h")).select(
        "node", "size", "label", F.xxhash64("block", "h").alias("key")))
    common = settled(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where(
        "low < high").select("key", "n"))
    kept = spread_join(sifted(rows, common, ["key"]), common, ["key"], ["node"], weight="n").where(F.col("n").isNotNull())
    text = Window.partitionBy("node")
    # the place counts those that only one label has as the rarest
    first = settled(kept.withColumn("place", F.row_number().over(text.orderBy("n", "key")) + F.col("size") - F.count("*").over(text)).where(
        F.col("place") <= 1 + _allowed(F.col("size"))).select(
        "key", "node", "label", "size", (F.col("size") - F.col("place") + 1).alias("left")))
    a, b = (first.select("key", *[F.col(c).alias(f"{n}_{c}") for c in first.columns if c != "key"]) for n in ("u", "v"))
    # of sets similar to s, both sizes together, s / (1 + s) is shared
    enough = (100 + SIMILAR) * F.least("u_left", "v_left") >= SIMILAR * (F.col("u_size") + F.col("v_size"))
    return a.join(b, "key").where((F.col("u_node") < F.col("v_node")) & (F.col("u_label") != F.col("v_label")) & enough).select(
        F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct()


def same_texts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(node, root) of the texts that are the same as another of their block, with the smallest node they reach.

    ``texts`` holds (node, complete), a node once; ``words`` holds (node, block, complete, words) of all of them, maybe of others
    too, and a text that any row calls complete is.  Both are read several times: pass stored rows.
    """
    sketches = sketched(texts, words)
    each = sketches.select("node", "size", F.explode("buckets").alias("bucket"))
    firsts = each.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = settled(firsts.join(sketches.select(F.col("node").alias("first"), F.col("size").alias("first_size")), "first"))
    members = settled(spread_join(sifted(each, buckets, ["bucket"]), buckets, ["bucket"], ["node"], weight="n").where(
        F.col("first").isNotNull()))
    stars = members.where((F.col("node") != F.col("first")) & _close(F.col("size"), F.col("first_size"))).select(
        F.col("first").alias("u"), F.col("node").alias("v"), F.lit(False).alias("cut")).distinct()
    whole = sketches.where("complete").select("node", "size", "block")
    cut = sketches.where(~F.col("complete") & (F.col("size") >= PROBES)).select(F.col("node").alias("u"), "block", "size", "sample")
    beside = whole.join(cut.select("block").distinct(), "block", "left_semi")
    shingles = sifted(words, beside, ["node"]).select("node", "block", _words("words").alias("w")).select(
        "node", "block", "w", F.explode_outer(_starts(F.col("w"))).alias("i")).select("node", "block", _run(F.col("w"), F.col("i")).alias("h"))
    cuts = settled(cut_candidates(cut, shingles, whole))
    unsure = cuts.where(~F.col("sure")).select("u", "v", F.lit(True).alias("cut"))
    links = settled(verified(settled(stars.unionByName(unsure)), words).union(cuts.where("sure").select("u", "v")))
    labels = connected(links)
    named = members.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    opened = settled(named.join(mixed.select("bucket"), "bucket", "left_semi").select("node", "size", "label").distinct())
    further = settled(verified(settled(rare_pairs(opened, words).withColumn("cut", F.lit(False))), words))
    return labels if further.isEmpty() else connected(links.union(further))
