"""Text rules as Column -> Column expressions.  No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire import vocab

# Java's \s is ASCII only; the rules below treat every Unicode space as whitespace.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, so a long expression is built and evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns whose values are worked out once per row.

    They come out of a generator, so a filter on them stays above it.  Below a projection the filter would hold a copy of
    the whole expression for every mention of the column.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace (``F.trim`` removes spaces only)."""
    return F.regexp_replace(_col(c), rf"\A{WS}+|{WS}+\z", "")


def clean(c: Column | str) -> Column:
    """NULL and the literal words null/undefined/nan become ''; whitespace collapses."""
    c = _col(c).cast("string")
    return F.when(c.isNull() | c.isin("null", "undefined", "nan"), "").otherwise(collapse(c))


def nonblank(c: Column | str) -> Column:
    """The value, or NULL when it is blank."""
    c = _col(c)
    return F.when(c != "", c)


def join_nonblank(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[nonblank(p) for p in parts])


def _utf16(code: Column) -> Column:
    """One UTF-16 unit as text; a lone surrogate cannot be encoded and becomes U+FFFD."""
    unit = F.lpad(F.hex(code), 4, "0")
    return F.when(code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
        F.decode(F.unhex(unit), "UTF-16BE")
    )


def _decode_entities(c: Column, pattern: str, to_code) -> Column:
    """Replace numeric entities in a single left-to-right pass: text pieces zipped with decoded codes."""
    def decoded(v: Column) -> Column:
        pieces = F.split(v, pattern.replace("(", "").replace(")", ""), -1)
        codes = F.regexp_extract_all(v, F.lit(pattern), F.lit(1))
        return F.array_join(
            F.zip_with(pieces, codes, lambda p, n: F.concat(p, F.coalesce(_utf16(to_code(n)), F.lit("")))), ""
        )

    return let(c, lambda v: F.when(v.contains("&#"), decoded(v)).otherwise(v))


def html_to_text(c: Column | str) -> Column:
    """HTML to readable text: fifteen ordered rewrites, then a trim.

    ``&amp;`` is decoded before numeric entities, so ``&amp;#65;`` reads ``A``.
    """
    c = F.coalesce(_col(c), F.lit(""))
    for pattern, repl in (
        (r"(?i)<script[\s\S]*?</script>", ""),
        (r"(?i)<style[\s\S]*?</style>", ""),
        (rf"(?i)<br{WS}*/?>", "\n"),
        (r"(?i)</(p|div|li|h[1-6]|tr)>", "\n"),
        (r"(?i)<li[^>]*>", "\u2022 "),
        (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, repl)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(char))
    # 10**16 is a multiple of 2**16, so the last 16 digits decide the 16-bit unit.
    c = _decode_entities(c, r"&#(\d+);", lambda n: F.right(n, F.lit(16)).cast("bigint") % 65536)
    c = _decode_entities(
        c, r"&#[xX]([0-9a-fA-F]+);",
        lambda n: F.conv(F.right(n, F.lit(4)), 16, 10).cast("bigint"),
    )
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(c)


# -- identity ---------------------------------------------------------------


def job_id(engine: Column, native_id: Column, apply_url: Column | None = None) -> Column:
    """``engine-`` plus sha1(engine:basis) in hex; basis falls back to the URL.

    The whole digest is the key: 12 digits of it would give two postings one key at some tens of millions of postings.
    """
    basis = F.coalesce(nonblank(native_id), apply_url if apply_url is not None else F.lit(""), F.lit(""))
    return F.concat(engine, F.lit("-"), F.sha1(F.concat(engine, F.lit(":"), basis)))


def short_id(ident: Column) -> Column:
    """The key as it is shown: 12 digits of the digest.  Not a key."""
    return F.regexp_replace(ident, "-([0-9a-f]{12})[0-9a-f]*$", "-$1")


# -- skills text --------------------------------------------------------------


def normalise_skill_text(c: Column | str) -> Column:
    c = F.lower(_col(c))
    c = F.regexp_replace(c, r"[（(\[{].*?[）)\]}]", " ")
    # Whitespace and dropped characters both end up as one space, so one pass does both.
    return F.trim(F.regexp_replace(c, "[^a-z0-9+#./-]+", " "))


def slugify_skill(c: Column | str) -> Column:
    c = F.regexp_replace(normalise_skill_text(c), rf"[./{SPACE}]+", "-")
    c = F.regexp_replace(c, "-+", "-")
    return F.regexp_replace(c, r"\A-|-\z", "")


# -- company and title keys ---------------------------------------------------


def _without_suffixes(c: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_replace(c, rf"\b({'|'.join(words)})\b", " ")


def company_key(c: Column | str) -> Column:
    """Employer identity that survives legal suffixes and punctuation."""
    c = F.regexp_replace(F.lower(_col(c)), "[.,]", " ")
    c = _without_suffixes(c, vocab.COMPANY_SUFFIXES + vocab.COMPANY_KEY_EXTRA_SUFFIXES)
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def title_key(c: Column | str) -> Column:
    c = F.regexp_replace(F.lower(_col(c)), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def opening_key(c: Column | str) -> Column:
    """Lower-case words of letters and digits of any script, one space apart; what stands in brackets stays."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def candidate_tokens(c: Column | str) -> Column:
    """Plausible board tokens for a company: the full name joined, then hyphenated."""
    base = F.regexp_replace(F.lower(_col(c)), "[.,'\u2019]", "")
    base = _without_suffixes(base, vocab.COMPANY_SUFFIXES)
    words = F.filter(F.split(base, "[^a-z0-9]+"), lambda w: w != "")
    both = F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-")))
    return F.filter(both, lambda t: F.length(t) >= 2)


def names_agree(a: Column, b: Column) -> Column:
    """Either name contains the other once reduced to letters and digits; blank agrees with anything."""
    x, y = (F.regexp_replace(F.lower(n), "[^a-z0-9]", "") for n in (a, b))
    return (x == "") | (y == "") | x.contains(y) | y.contains(x)


def squashed_name(c: Column | str) -> Column:
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("")))


def contains_typed(c: Column | str, typed: str) -> Column:
    """Case-insensitive LIKE around what a user typed: % and _ stay wildcards, a backslash is itself."""
    escaped = typed.replace("\\", "\\\\")
    return _col(c).ilike(f"%{escaped}%")


# -- thread header ------------------------------------------------------------


def parse_header(c: Column | str) -> Column:
    """Company, title and location from the first non-blank line of a pipe-delimited posting."""
    lines = F.filter(F.split(_col(c), "\n"), lambda s: strip(s) != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    parts = F.filter(F.transform(F.split(first, r"\|"), clean), lambda p: p != "")

    def read(parts: Column) -> Column:
        rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
        where = F.filter(rest, lambda p: p.rlike(r"(?i)\b(remote|onsite|on-site|hybrid)\b"))
        location = F.coalesce(F.get(where, F.lit(0)), F.lit(""))
        role = F.filter(rest, lambda p: (p != location) & ~p.rlike(rf"[$£€₹]{WS}?\d"))
        # A line of separators only carries nothing; every field is optional.
        company = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        title = F.coalesce(F.get(role, F.lit(0)), F.when(company == "", clean(first)), company)
        return F.struct(company.alias("company"), title.alias("title"), location.alias("location"))

    return let(parts, read)


# -- résumé text --------------------------------------------------------------

SUSPECT_WORDS = 60


def tidy(c: Column | str) -> Column:
    c = F.regexp_replace(_col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def word_count(c: Column | str) -> Column:
    collapsed = collapse(c)
    return F.when(collapsed == "", 0).otherwise(F.size(F.split(collapsed, " ")))


def suspect_extraction(c: Column | str) -> Column:
    return word_count(c) < SUSPECT_WORDS


# -- lists --------------------------------------------------------------------


def string_list(c: Column | str) -> Column:
    """A comma-separated answer as distinct trimmed values in order."""
    return string_array(F.split(_col(c), ","))


def string_array(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, strip), lambda v: v.isNotNull() & (v != "")))


def json_array(c: Column | str, ddl: str = "string") -> Column:
    """A JSON column as an array; absent, malformed or non-array text gives an empty array."""
    return F.coalesce(F.from_json(_col(c), f"array<{ddl}>"), F.array().cast(f"array<{ddl}>"))


def model_json(c: Column | str) -> Column:
    """The JSON part of a model answer: the text itself, a fenced block, or the outermost braces."""
    def candidate(text: Column) -> Column:
        fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
        braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
        is_json = F.try_parse_json(text).isNotNull() & (text != "")
        return F.when(is_json, text).when(text.rlike(r"```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(braces)

    return let(let(strip(_col(c)), candidate), lambda j: F.when(F.try_parse_json(j).isNotNull(), nonblank(j)))


# -- URLs ---------------------------------------------------------------------


def host_of(c: Column | str) -> Column:
    """Lower-case host (with a non-default port) of an http(s) URL, else NULL."""
    c = _col(c)
    host = F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1))
    host = F.when(c.rlike("(?i)^http://"), F.regexp_replace(host, r":80$", "")).otherwise(
        F.regexp_replace(host, r":443$", "")
    )
    return nonblank(host)


def path_of(c: Column | str) -> Column:
    """Path plus query, ``/`` when there is none or the text is not a URL."""
    c = _col(c)
    path = F.regexp_extract(c, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(c, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+[^?#]*(\?[^#]+)", 1)
    return F.concat(F.when(path == "", "/").otherwise(path), query)


def has_og_title(body: Column | str) -> Column:
    body = _col(body)
    tag_first = r"""(?i)<meta[^>]+property=["']og:title["'][^>]*content=["']([^"']*)["']"""
    content_first = r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+property=["']og:title["']"""
    value = F.when(body.rlike(tag_first), F.regexp_extract(body, tag_first, 1)).otherwise(
        F.regexp_extract(body, content_first, 1)
    )
    return strip(value) != ""


def escape_like(text: str) -> str:
    """Make ``\\ % _`` in user text literal inside a LIKE pattern."""
    for ch in ("\\", "%", "_"):
        text = text.replace(ch, "\\" + ch)
    return text


def file_extension(c: Column | str) -> Column:
    """Accepted résumé extension (pdf, docx, txt, md) of a file name, else NULL."""
    ext = F.lower(F.regexp_extract(_col(c), r"\.([^.]*)\z", 1))
    return F.when(ext.isin("pdf", "docx", "txt", "md"), ext)


# -- search terms -------------------------------------------------------------


WORD_BREAK = "[^a-z0-9+#.]+"


def words(c: Column | str) -> Column:
    """Meaningful words of a text: split, drop single characters and stopwords."""
    return F.filter(
        F.split(F.lower(_col(c)), WORD_BREAK),
        lambda w: (F.length(w) > 1) & ~w.isin(*vocab.STOPWORDS),
    )


def signal_words(term: str) -> list[str]:
    """Words of a search term that say what the work is; level words only when nothing else remains."""
    import re

    every = [w for w in re.split(WORD_BREAK, term.lower()) if len(w) > 1 and w not in vocab.STOPWORDS]
    return [w for w in every if w not in vocab.SENIORITY_WORDS] or every


def matches_terms(terms: list[str], title: Column, tags: Column | None = None) -> Column:
    """Does a posting relate to any search term?  No terms keeps everything.

    The wanted words are meaningful ones, so the title's are not sorted out first.
    """
    if not terms:
        return F.lit(True)
    wanted = sorted({w for t in terms for w in signal_words(t)})
    if not wanted:
        return F.lit(False)
    text = title if tags is None else F.concat_ws(" ", title, F.concat_ws(" ", tags))
    return F.arrays_overlap(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), F.array(*[F.lit(w) for w in wanted]))
