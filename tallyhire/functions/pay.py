"""Pay: reading it from text, describing it, and comparing it with a target."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from tallyhire.functions.text import SPACE, WS, let, nonblank

# Pay cues, number formats, scales, symbols, periods, plausible bounds.
CUE = r"(?i)\b(salary|compensation|pay range|pay|base|remuneration|ctc|package|offers?)\b"
FIGURE = rf"(\d[\d,{SPACE}]*(?:\.\d+)?){WS}*([a-zA-Z]{{1,6}})?"
SEPARATOR = rf"(?:-|–|—|\bto\b|\bup{WS}+to\b|\band\b)"
RANGE = rf"(?i)([$£€₹])?{WS}?{FIGURE}{WS}*{SEPARATOR}{WS}*([$£€₹])?{WS}?{FIGURE}"
SINGLE = rf"(?i)([$£€₹]){WS}?{FIGURE}"
HOURLY = rf"(?i)\b(per hour|hourly|/{WS}?hr|/{WS}?hour|an hour)\b"
MONTHLY = rf"(?i)\b(per month|monthly|/{WS}?mo|/{WS}?month|a month|pm)\b"
SCALES = {
    "lpa": 1e5, "lakh": 1e5, "lakhs": 1e5, "l": 1e5,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "k": 1e3, "m": 1e6,
}
CURRENCY_SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "₹": "INR"}
PER_YEAR = {"annual": 1, "monthly": 12, "hourly": 52 * 40}
PLAUSIBLE = {"hourly": (5, 5_000), "monthly": (500, 10_000_000), "annual": (1_000, 100_000_000)}
MAX_SPREAD = 20
WINDOW = 400
#: Any cue, with the characters after it as a group; a figure counts as one of them and is never cut.
_WHOLE = re.sub(r"\((?!\?)", "(?:", f"{RANGE}|{SINGLE}")
CUE_AND_NEAR = rf"{CUE}(?=((?>{_WHOLE}|[\s\S]){{0,{WINDOW}}}))"
#: Any range, with what follows it as a group.
RANGE_AND_NEAR = rf"{RANGE}(?=([\s\S]{{0,{WINDOW}}}))"
TARGET_BAND = 0.02


def _lookup(key: Column, table: dict, default: Column) -> Column:
    """The key is bound first: a chain over an expression reads it once per entry."""
    return let(key, lambda k: reduce(lambda acc, kv: acc.when(k == kv[0], F.lit(kv[1])), list(table.items()), F).otherwise(default))


def salary_struct(lo: Column, hi: Column, currency: Column, period: Column, state: Column) -> Column:
    return F.struct(
        lo.cast("double").alias("min"), hi.cast("double").alias("max"),
        currency.cast("string").alias("currency"), period.cast("string").alias("period"),
        state.cast("string").alias("state"),
    )


def absent() -> Column:
    none = F.lit(None)
    return salary_struct(none, none, F.lit(""), F.lit("annual"), F.lit("absent"))


def _number(c: Column) -> Column:
    return F.regexp_replace(c, rf"[,{SPACE}]", "").try_cast("double")


def _scaled(value: Column, suffix: Column) -> Column:
    return value * _lookup(F.lower(suffix), SCALES, F.lit(1.0))


def _plausible(lo: Column, hi: Column, period: Column) -> Column:
    in_bounds = reduce(
        lambda acc, kv: acc.when(period == kv[0], (lo >= kv[1][0]) & (hi <= kv[1][1])), list(PLAUSIBLE.items()), F
    )
    ok = (lo > 0) & (hi > 0) & (hi >= lo) & (hi <= lo * MAX_SPREAD) & in_bounds
    return F.coalesce(ok, F.lit(False))


def parse_salary(text: Column, fallback_currency: str = "") -> Column:
    """A pay range from prose: the first plausible one near a pay cue, else the first plausible one of the whole text.

    Near is ``WINDOW`` characters after a cue; cues are tried in their order, and in a cue's window all ranges are.  A single
    figure counts only near a cue without a range, and only while no cue before had one: an implausible range is never
    followed by half of another.
    """
    text = F.coalesce(text, F.lit(""))
    fallback = F.lit(fallback_currency)
    state = F.lit("parsed")

    def period(near: Column) -> Column:
        return F.when(near.rlike(HOURLY), "hourly").when(near.rlike(MONTHLY), "monthly").otherwise("annual")

    def found(figure: Column, is_pair: bool, per: Column) -> Column:
        return F.struct(figure.alias("figure"), F.lit(is_pair).alias("is_pair"), per.alias("period"))

    def near_cue(near: Column) -> Column:
        pairs, one = F.regexp_extract_all(near, F.lit(RANGE), F.lit(0)), F.regexp_extract(near, SINGLE, 0)

        def listed(w: Column) -> Column:
            return F.when(F.size(w["pairs"]) > 0, F.transform(w["pairs"], lambda p: found(p, True, w["period"]))).when(
                w["one"] != "", F.array(found(w["one"], False, w["period"]))).otherwise(none)

        return let(F.struct(pairs.alias("pairs"), one.alias("one"), period(near).alias("period")), listed)

    none = F.array().cast("array<struct<figure:string,is_pair:boolean,period:string>>")
    with_figure = text.rlike(r"\d")  # a text without a digit has no figure, and no cue needs looking at
    nears = F.filter(F.regexp_extract_all(text, F.lit(CUE_AND_NEAR), F.lit(2)), lambda n: n.rlike(r"\d"))
    cued = F.when(with_figure, F.flatten(F.transform(nears, near_cue))).otherwise(none)

    # what stands at the head of the text is also near to a first range that begins there
    head = F.when(F.regexp_instr(text, F.lit(RANGE)) <= WINDOW, F.substring(text, 1, WINDOW)).otherwise("")
    everywhere = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(RANGE_AND_NEAR), F.lit(0)).alias("pair"),
                     F.regexp_extract_all(text, F.lit(RANGE_AND_NEAR), F.lit(7)).alias("near")),
        lambda m, i: found(m["pair"], True, period(F.when(i == 0, F.concat(head, m["near"])).otherwise(m["near"]))))

    # The groups are read from the short matches, each once; only those of the figure's own kind.
    def pair(m: Column) -> Column:
        names = ("sym1", "lo", "lo_suffix", "sym2", "hi", "hi_suffix")

        def read(g: Column) -> Column:
            return let(F.coalesce(nonblank(g["hi_suffix"]), g["lo_suffix"]), lambda suffix: F.struct(
                m["is_pair"].alias("is_pair"), m["period"].alias("period"),
                _scaled(_number(g["lo"]), F.coalesce(nonblank(g["lo_suffix"]), suffix)).alias("lo"),
                _scaled(_number(g["hi"]), suffix).alias("hi"),
                _lookup(F.coalesce(nonblank(g["sym1"]), g["sym2"]), CURRENCY_SYMBOLS, F.when(
                    suffix.rlike("(?i)(lpa|lakh|crore)"), F.lit("INR")).otherwise(fallback)).alias("currency")))

        return let(F.struct(*[F.regexp_extract(m["figure"], RANGE, i + 1).alias(n) for i, n in enumerate(names)]), read)

    def single(m: Column) -> Column:
        symbol, figure, suffix = (F.regexp_extract(m["figure"], SINGLE, i) for i in (1, 2, 3))
        return let(_scaled(_number(figure), suffix), lambda value: F.struct(
            m["is_pair"].alias("is_pair"), m["period"].alias("period"), value.alias("lo"), value.alias("hi"),
            _lookup(symbol, CURRENCY_SYMBOLS, fallback).alias("currency")))

    def figures(m: Column) -> Column:
        return F.when(m["is_pair"], pair(m)).otherwise(single(m))

    def first_plausible(read: Column) -> Column:
        first_pair = F.array_position(F.transform(read, lambda f: f["is_pair"]), True)
        return F.get(F.filter(read, lambda f, i: _plausible(f["lo"], f["hi"], f["period"]) & (
            f["is_pair"] | (first_pair == 0) | (i + 1 < first_pair))), F.lit(0))

    def remaining(c: Column) -> Column:
        return F.filter(everywhere, lambda m: ~F.exists(c, lambda seen: seen["figure"] == m["figure"]))

    def best(c: Column) -> Column:
        return F.coalesce(let(F.transform(c, figures), first_plausible),
                          F.when(with_figure, let(F.transform(remaining(c), figures), first_plausible)))

    def verdict(f: Column) -> Column:
        return F.when(f.isNull(), absent()).otherwise(salary_struct(f["lo"], f["hi"], f["currency"], f["period"], state))

    return let(let(cued, best), verdict)


def from_structured(lo: Column, hi: Column, currency: Column, period: Column | None = None,
                    predicted: Column | None = None) -> Column:
    """Figures a source handed over as fields; a predicted figure is an estimate."""
    lo, hi = lo.cast("double"), hi.cast("double")
    state = F.lit("disclosed") if predicted is None else (
        F.when(F.coalesce(predicted, F.lit(False)), "estimated").otherwise("disclosed")
    )
    unknown = (lo.isNull() | F.isnan(lo)) & (hi.isNull() | F.isnan(hi))
    return F.when(unknown, absent()).otherwise(
        salary_struct(lo, hi, F.coalesce(currency, F.lit("")),
                      F.coalesce(period, F.lit("annual")) if period is not None else F.lit("annual"), state)
    )


def compare_to_target(s: Column, target_min: float | None, target_max: float | None,
                      currency: str, period: str) -> Column:
    """below / within / above a target range; unknown whenever the comparison would be meaningless."""
    if target_min is None and target_max is None:
        return F.lit("unknown")
    top = F.coalesce(s["max"], s["min"])
    bottom = F.coalesce(s["min"], s["max"])
    other_currency = (s["currency"] != "") & F.lit(currency != "") & (s["currency"] != currency)
    verdict = F.when(
        (s["state"] == "absent") | (s["period"] != period) | other_currency | top.isNull(), "unknown"
    )
    if target_min is not None:
        verdict = verdict.when(top < target_min, "below")
    if target_max is not None:
        verdict = verdict.when(bottom > target_max, "above")
    return verdict.otherwise("within")


def _short_decimal(c: Column, places: int) -> Column:
    """Fixed places without trailing zeros, as a person would write the number."""
    fixed = F.round(c, places).cast(f"decimal(30,{places})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")


def _plain_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")


def compact_amount(value: Column, currency: Column) -> Column:
    inr = currency == "INR"
    return (
        F.when(inr & (value >= 1e7), F.concat(_short_decimal(value / 1e7, 2), F.lit("Cr")))
        .when(inr & (value >= 1e5), F.concat(_short_decimal(value / 1e5, 2), F.lit("L")))
        .when(value >= 1e6, F.concat(_short_decimal(value / 1e6, 1), F.lit("M")))
        .when(value >= 1e3, F.concat(F.floor(value / 1e3 + 0.5).cast("string"), F.lit("k")))
        .otherwise(_plain_number(value))
    )


def format_salary(s: Column) -> Column:
    """One short line; absence is stated, never blank."""
    return let(s, _salary_line)


def _salary_line(s: Column) -> Column:
    symbol = _lookup(s["currency"], {v: k for k, v in CURRENCY_SYMBOLS.items()}, F.lit(""))
    lo = F.concat(symbol, compact_amount(s["min"], s["currency"]))
    hi = F.concat(symbol, compact_amount(s["max"], s["currency"]))
    body = F.when(
        s["min"].isNotNull() & s["max"].isNotNull() & (s["min"] != s["max"]), F.concat(lo, F.lit("–"), hi)
    ).otherwise(F.coalesce(lo, hi))
    per = F.when(s["period"] == "annual", "").when(s["period"] == "monthly", "/mo").otherwise("/hr")
    note = F.when(s["state"] == "estimated", " (estimated)").when(s["state"] == "parsed", " (from text)").otherwise("")
    return F.when(s["state"] == "absent", "not stated").otherwise(F.concat(body, per, note))


def salary_shape(lo: Column, hi: Column) -> Column:
    return (
        F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), "range")
        .when(lo.isNotNull() | hi.isNotNull(), "single")
        .otherwise("absent")
    )


def to_annual(amount: Column, period: Column) -> Column:
    per = _lookup(F.lower(F.coalesce(period, F.lit("annual"))), PER_YEAR, F.lit(None))
    return F.floor(amount * per + 0.5)


def salary_vs_target(lo: Column, hi: Column, currency: Column, period: Column,
                     target_min: float | None, target_currency: str, target_period: str = "annual") -> Column:
    """Stated top of range against a floor, with a two per cent band; currencies are never converted."""
    if target_min is None or target_period.lower() not in PER_YEAR:
        return F.lit("unknown")
    goal = int(target_min * PER_YEAR[target_period.lower()] + 0.5)
    slack = goal * TARGET_BAND
    stated = to_annual(F.coalesce(hi, lo), period)
    given = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    return (
        F.when(stated.isNull() | (given == "") | (given != target_currency.strip().upper()), "unknown")
        .when(stated > goal + slack, "above")
        .when(stated >= goal - slack, "within")
        .otherwise("below")
    )


def describe_salary(lo: Column, hi: Column, currency: Column, period: Column, verdict: Column) -> Column:
    def grouped(c: Column) -> Column:
        return F.coalesce(F.call_function("format_number", c, F.lit("#,##0.###")), F.lit(""))

    shape = salary_shape(lo, hi)
    figure = F.when(shape == "range", F.concat(grouped(lo), F.lit("–"), grouped(hi))).otherwise(
        F.coalesce(nonblank(grouped(lo)), grouped(hi))
    )
    per = F.when(period.isNotNull() & (period != "annual") & (period != ""), F.concat(F.lit("/"), period)).otherwise("")
    against = F.when(verdict == "unknown", "").otherwise(F.concat(F.lit(" ("), verdict, F.lit(" target)")))
    line = F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), figure, per, against)
    return F.when(shape == "absent", "pay not stated").otherwise(F.trim(line))


def parse_user_amount(c: Column) -> Column:
    """An amount as people type it: separators and symbols stripped, k/m/l/lpa understood."""
    plain = F.regexp_replace(F.lower(F.trim(c)), rf"[,_{SPACE}$£€₹]", "")
    pattern = r"^(\d+(?:\.\d+)?)(k|l|lpa|m)?$"
    amount = F.regexp_extract(plain, pattern, 1).try_cast("double")
    scale = _lookup(F.regexp_extract(plain, pattern, 2), {"k": 1e3, "m": 1e6, "l": 1e5, "lpa": 1e5}, F.lit(1.0))
    return F.when(plain.rlike(pattern), F.floor(amount * scale + 0.5))


def optional_number(c: Column) -> Column:
    """A number with separators removed; NULL for an empty or unreadable field."""
    return F.regexp_replace(c.cast("string"), rf"[,_{SPACE}]", "").try_cast("double")


def clamp01(c: Column) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(F.lit(0.0))
