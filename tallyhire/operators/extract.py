"""Finding skills in free text.

A scan of every spelling against every text is a theta join.  Here it stays inside
the row: the text is split into tokens once, tokens are intersected with the anchor
token of each spelling, and only the spellings whose anchor occurs are verified with
the boundary pattern.  Every spelling contains an alphanumeric run and a boundary
match forces that run to be a whole token, so the prefilter loses nothing; a spelling
that is nothing but its anchor needs no pattern at all.  The whole operator is one
narrow pass over the text: no explode before verification, no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire import vocab
from tallyhire.functions import text as tx



def _bounded(term: str) -> str:
    return f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"


def _anchor(term: str) -> str:
    return max(re.findall("[a-z0-9]+", term), key=len)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_map(entries: dict[str, list[str]]) -> str:
    return "map(" + ", ".join(f"{_sql(k)}, array({', '.join(v)})" for k, v in entries.items()) + ")"


@lru_cache(maxsize=1)
def _anchors() -> tuple[str, ...]:
    return tuple(dict.fromkeys(_anchor(t.term) for t in vocab.search_terms()))


@lru_cache(maxsize=1)
def _terms_by_anchor() -> str:
    """anchor -> terms, as a constant map expression (folded once by the optimizer)."""
    table: dict[str, list[str]] = {}
    for t in vocab.search_terms():
        s, anchor = vocab.by_slug()[t.slug], _anchor(t.term)
        pattern = "CAST(NULL AS STRING)" if anchor == t.term else _sql(_bounded(t.term))
        table.setdefault(anchor, []).append(
            f"named_struct('rank', {t.rank}, 'term', {_sql(t.term)}, 'slug', {_sql(t.slug)}, 'label', {_sql(s.label)}, "
            f"'category', {_sql(s.category)}, 'pattern', {pattern}, 'ambiguous', {str(t.ambiguous).lower()})"
        )
    return _sql_map(table)


@lru_cache(maxsize=1)
def _spellings_by_slug() -> str:
    return _sql_map({s.slug: [_sql(f"(?i){_bounded(sp)}") for sp in s.spellings()] for s in vocab.skills()})


def spelling_patterns(slug: Column) -> Column:
    """Boundary patterns of every way a skill is written."""
    return F.element_at(F.expr(_spellings_by_slug()), slug)


def has_skill_context(original: Column, term: str) -> Column:
    """Does an ambiguous name look like a skill in this lower-cased text?

    A verb continuation anywhere rejects it outright.
    """
    t = re.escape(term)
    sp = tx.WS
    as_verb = rf"\b{t}[{tx.SPACE}-]+(?:{'|'.join(vocab.VERB_CONTINUATIONS)})\b"
    in_list = rf"(?:[,/|•·:]{sp}*{t}\b)|(?:\b{t}{sp}*[,/|])"
    adjacent = rf"\b(?:{'|'.join(vocab.ADJACENT_CUES)}){sp}+(?:the{sp}+)?{t}\b"
    strong = rf"\b(?:{'|'.join(vocab.STRONG_CUES)})\b[^.!?\n]{{0,18}}\b{t}\b"
    noun = rf"\b{t}{sp}+(?:{'|'.join(vocab.TECH_NOUNS)})\b"
    return original.contains(term) & ~original.rlike(as_verb) & (
        original.rlike(in_list) | original.rlike(adjacent) | original.rlike(noun) | original.rlike(strong)
    )


def _any_of(cues: tuple[str, ...]) -> str:
    """A pattern of all cues, short ones first, so that a match is the shortest cue at its place."""
    return "(?:" + "|".join(re.escape(c) for c in sorted(cues, key=len)) + ")"


def cue_index(text: Column) -> Column:
    """The cues of a text in order: array of (start, preferred_end, required_end), 1-based, ends after the cue.

    The text is cut once before every place where a cue begins; the lengths of the pieces add up to the places.  An end is
    NULL where no cue of that kind begins.
    """
    every = vocab.PREFERRED_CUES + vocab.REQUIRED_CUES
    longest = max(map(len, every))

    def end(window: Column, start: Column, cues: tuple[str, ...]) -> Column:
        cue = F.length(F.regexp_extract(window, rf"\A{_any_of(cues)}", 0))
        return F.when(cue > 0, start + cue)

    def marks(t: Column) -> Column:
        starts = F.aggregate(
            F.split(t, f"(?={_any_of(every)})", -1), F.array(F.lit(1)),
            lambda out, piece: F.concat(out, F.array(F.element_at(out, -1) + F.length(piece))))

        def mark(start: Column) -> Column:
            return tx.let(F.substring(t, start, F.lit(longest)), lambda w: F.struct(
                start.alias("start"), end(w, start, vocab.PREFERRED_CUES).alias("preferred_end"),
                end(w, start, vocab.REQUIRED_CUES).alias("required_end")))

        return F.filter(F.transform(starts, mark), lambda m: m["preferred_end"].isNotNull() | m["required_end"].isNotNull())

    return tx.let(text, marks)


def requirement_at(cues: Column, position: Column, lookback: int | None = None) -> Column:
    """required / preferred from the last cue that ends before a 1-based position; by ``cue_index`` of the text.

    With ``lookback`` only cues that begin in as many characters before the position count.
    """
    def last(kind: str) -> Column:
        def inside(m: Column) -> Column:
            ended = m[f"{kind}_end"] <= position
            return ended if lookback is None else ended & (m["start"] >= position - lookback)

        return F.coalesce(F.get(F.transform(F.slice(F.filter(cues, inside), -1, 1), lambda m: m["start"]), F.lit(0)), F.lit(0))

    return F.when(last("preferred") > last("required"), "preferred").otherwise("required")


def with_skills(df: DataFrame, text: Column, flat: bool = False, out: str = "skills") -> DataFrame:
    """Add ``out``: array of (ordinal, slug, label, category, requirement, evidence).

    ``flat`` skips the required/preferred split (résumés have none).
    """
    table = F.expr(_terms_by_anchor())
    scratch = ["_norm", "_orig", "_hits", "_ctx", "_found", "_soft"]
    any_preferred = "|".join(re.escape(c) for c in vocab.PREFERRED_CUES)
    staged = (
        df.withColumn("_norm", tx.normalise_skill_text(F.coalesce(text, F.lit(""))))
        .withColumn("_orig", F.lower(F.coalesce(text, F.lit(""))))
        .withColumn("_hits", F.array_intersect(
            F.array_distinct(F.split("_norm", "[^a-z0-9]+")), F.array(*[F.lit(a) for a in _anchors()])))
        # A text without any preferred cue needs no look-back.
        .withColumn("_soft", F.lit(False) if flat else F.col("_norm").rlike(any_preferred))
    )
    hits, norm, orig = F.col("_hits"), F.col("_norm"), F.col("_orig")
    contexts = [
        F.when(F.array_contains(hits, t.term) & has_skill_context(orig, t.term), F.lit(t.term))
        for t in vocab.search_terms() if t.ambiguous
    ]
    staged = staged.withColumn("_ctx", F.array_compact(F.array(*contexts)))
    candidates = F.flatten(F.transform(hits, lambda h: F.element_at(table, h)))
    verified = F.filter(
        candidates,
        lambda t: (t["pattern"].isNull() | (norm.contains(t["term"]) & F.rlike(norm, t["pattern"])))
        & (~t["ambiguous"] | F.array_contains(F.col("_ctx"), t["term"])),
    )
    # Scan order is longest spelling first; the first verified spelling of a slug wins.
    staged = staged.withColumn("_found", F.array_sort(verified))
    winners = F.filter("_found", lambda t, i: F.array_position(F.col("_found.slug"), t["slug"]) == i + 1)

    def row(t: Column, i: Column, need: Column) -> Column:
        return F.struct(
            i.alias("ordinal"), t["slug"].alias("slug"), t["label"].alias("label"), t["category"].alias("category"),
            need.alias("requirement"), t["term"].alias("evidence"),
        )

    plain = F.transform(winners, lambda t, i: row(t, i, F.lit("required")))
    if flat:
        return staged.withColumn(out, plain).drop(*scratch)
    # one index of the cues for all hits of the text
    weighed = tx.let(cue_index(norm), lambda cues: F.transform(
        winners, lambda t, i: row(t, i, requirement_at(cues, F.position(t["term"], norm)))))
    return staged.withColumn(out, F.when(F.col("_soft"), weighed).otherwise(plain)).drop(*scratch)


def extract_skills(df: DataFrame, key: str, text: Column, flat: bool = False) -> DataFrame:
    """One row per (key, skill) in scan order."""
    found = with_skills(df.select(F.col(key), text.alias("_text")), F.col("_text"), flat, "_skills")
    # An outer generator keeps the optimizer from copying the whole scan into an inferred size filter.
    return found.select(key, F.inline_outer("_skills")).filter(F.col("slug").isNotNull())


# -- lists a source already handed over ---------------------------------------


def shipped_aliases(spark) -> DataFrame:
    return spark.createDataFrame(list(vocab.alias_to_slug().items()), "alias string, canonical string")


def known_aliases(spark, learned: DataFrame | None = None) -> DataFrame:
    """Shipped spellings plus learned ones; a learned spelling never redefines a shipped one."""
    shipped = shipped_aliases(spark)
    if learned is None:
        return shipped
    extra = (
        learned.select(tx.normalise_skill_text("alias").alias("alias"), "canonical")
        .filter(F.col("alias") != "").join(F.broadcast(shipped), "alias", "left_anti")
        .groupBy("alias").agg(F.min("canonical").alias("canonical"))
    )
    return shipped.unionByName(extra)


def learn_alias(spark, learned: DataFrame, proposed: DataFrame) -> DataFrame:
    """Append proposed (alias, canonical) rows that neither the shipped nor the learned table knows."""
    fresh = (
        proposed.select(tx.normalise_skill_text("alias").alias("alias"), "canonical").filter(F.col("alias") != "")
        .groupBy("alias").agg(F.min("canonical").alias("canonical"))
        .join(F.broadcast(shipped_aliases(spark)), "alias", "left_anti")
        .join(learned.select("alias"), "alias", "left_anti")
    )
    return learned.select("alias", "canonical").unionByName(fresh)


def resolve_labels(df: DataFrame, label: str, learned: DataFrame | None = None, out: str = "slug") -> DataFrame:
    """Written skill -> canonical slug; NULL for noise.  Unknown skills keep a slug of their own."""
    from tallyhire.operators.skew import bounded_broadcast

    aliases = known_aliases(df.sparkSession, learned)
    aliases = F.broadcast(aliases) if learned is None else bounded_broadcast(aliases)
    staged = df.withColumn("_n", tx.normalise_skill_text(label)).withColumn("_s", tx.slugify_skill(label))
    by_text = aliases.select(F.col("alias").alias("_n"), F.col("canonical").alias("_by_text"))
    by_slug = aliases.select(F.col("alias").alias("_s"), F.col("canonical").alias("_by_slug"))
    slug = F.coalesce(
        F.col("_by_text"),
        F.when((F.length("_n") >= 2) & (F.col("_s") != ""), F.coalesce(F.col("_by_slug"), F.col("_s"))),
    )
    return (
        staged.join(by_text, "_n", "left").join(by_slug, "_s", "left")
        .withColumn(out, slug).select(*df.columns, out)
    )


def vocabulary_frame(spark) -> DataFrame:
    return spark.createDataFrame(
        [(s.slug, s.label, s.category) for s in vocab.skills()], "slug string, label string, category string"
    )


def label_skills(df: DataFrame, slug: str = "slug") -> DataFrame:
    """Add display label and category; unknown slugs label themselves, category ``other``."""
    names = F.broadcast(vocabulary_frame(df.sparkSession)).withColumnsRenamed(
        {"slug": slug, "label": "_label", "category": "_category"}
    )
    return (
        df.join(names, slug, "left")
        .withColumn("label", F.coalesce("_label", slug)).withColumn("category", F.coalesce("_category", F.lit("other")))
        .drop("_label", "_category")
    )


def normalise_skill_list(df: DataFrame, key: str, labels: str, learned: DataFrame | None = None) -> DataFrame:
    """(key, array of written skills) -> one row per distinct slug; the first spelling is the evidence."""
    from tallyhire.operators.skew import first_by

    each = df.select(key, F.posexplode_outer(labels).alias("ordinal", "evidence")).filter(F.col("evidence").isNotNull())
    resolved = resolve_labels(each, "evidence", learned).filter(F.col("slug").isNotNull())
    return label_skills(first_by(resolved, [key, "slug"], ["ordinal"])).withColumn("requirement", F.lit("required"))
