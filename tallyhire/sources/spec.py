"""A source is a declaration: where its records sit and how each column is read.

Responses are captured outside Spark and arrive as a DataFrame of payloads, one row per
response: ``seq`` (request order), ``kind``, ``board_company``, ``board_token``,
``body`` (JSON text), ``http_status`` and ``error``.  Everything after that is one narrow
projection per source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.dates import parse_posted_at, within_age
from tallyhire.functions.pay import absent
from tallyhire.functions.text import matches_terms, once
from tallyhire.schemas import RAW_JOB, SALARY


@dataclass(frozen=True)
class SearchQuery:
    terms: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    remote_only: bool = False
    max_age_days: float = 30

    def country(self) -> str:
        return "us" if self.locations and "us" in self.locations[0].lower() else "in"


@dataclass(frozen=True)
class SourceSpec:
    """``envelope`` + ``path`` locate the record array; ``record`` is a record's DDL.

    ``columns`` maps the parsed record to ingest columns.  Besides the ingest columns it
    may give ``keep`` (drop a record when not true), ``tags`` and ``match_title`` (what the
    term filter reads).  ``unique`` says whether a repeated native id is dropped before or
    after the client-side filters.
    """

    id: str
    family: str
    label: str
    quality: str
    envelope: str
    path: str | None
    record: str
    columns: Callable[[Callable[[str], Column], SearchQuery], dict[str, Column]]
    keyless: bool = True
    needs_boards: bool = False
    filter_terms: bool = False
    filter_age: bool = False
    unique: str | None = None
    kind: str | None = None
    stage: Callable[[DataFrame], DataFrame] | None = None
    join: Callable[[DataFrame, DataFrame], DataFrame] | None = field(default=None)
    payload_error: Callable[[], Column] | None = None
    fails_on_any_error: bool = False


def rec(name: str) -> Column:
    return F.col(f"rec.{name}")


def good_payloads(spec: SourceSpec, payloads: DataFrame) -> DataFrame:
    return payloads.filter(payload_failure(spec).isNull())


def payload_failure(spec: SourceSpec) -> Column:
    """Why a response is unusable, NULL when it is fine."""
    own = spec.payload_error() if spec.payload_error else F.lit(None)
    http = F.when(F.coalesce(F.col("http_status"), F.lit(200)) >= 400, F.concat(F.lit("HTTP "), F.col("http_status")))
    return F.coalesce(F.col("error"), http, own)


def records(spec: SourceSpec, payloads: DataFrame) -> DataFrame:
    """One row per record: untouched JSON text and its parsed struct; bad shapes give no rows."""
    usable = good_payloads(spec, payloads)
    if spec.kind is not None:
        usable = usable.filter(F.col("kind") == spec.kind)
    parsed = F.from_json("body", spec.envelope)
    items = parsed
    for step in (spec.path or "").split("."):
        items = items[step] if step else items
    extra = parsed["name"] if spec.envelope.startswith("name ") else F.lit(None).cast("string")
    each = usable.select(
        "seq", "board_company", "board_token", extra.alias("envelope_name"),
        F.posexplode_outer(items).alias("pos", "raw"),
    ).filter(F.col("raw").isNotNull())
    return once(each, rec=F.from_json("raw", spec.record)).filter(F.col("rec").isNotNull())


def read_source(spec: SourceSpec, payloads: DataFrame, query: SearchQuery, now: Column) -> DataFrame:
    """Payloads -> ingest records (plus ``seq``/``pos`` for order)."""
    rows = records(spec, payloads)
    if spec.join is not None:
        rows = spec.join(rows, payloads)
    if spec.stage is not None:
        rows = spec.stage(rows)
    cols = dict(spec.columns(rec, query))
    defaults = {
        "description_complete": F.length("description") > 0,
        "remote": F.lit(None), "salary": absent(), "employment_type": F.lit(None), "posted_at": F.lit(None),
        "skills": F.array(), "tags": F.lit(None), "match_title": F.col("title"), "keep": F.lit(True),
    }
    late = {k: v for k, v in defaults.items() if k not in cols}
    types = {"description_complete": "boolean", "remote": "boolean", "salary": SALARY, "employment_type": "string",
             "posted_at": "string", "skills": "array<string>", "tags": "array<string>"}

    def client_filters(d: DataFrame) -> DataFrame:
        if spec.filter_terms:
            d = d.filter(matches_terms(list(query.terms), cols.get("match_title", cols["title"]), cols.get("tags")))
        if spec.filter_age:
            d = d.filter(within_age(parse_posted_at(cols.get("posted_at", F.lit(None).cast("string"))), now, query.max_age_days))
        return d

    # rows are picked first, from the few columns that decide; what is dropped is not worked out
    rows = rows.filter(F.coalesce(cols.get("keep", F.lit(True)), F.lit(False)))
    if spec.unique is not None:
        rows = rows.withColumn("native_id", cols["native_id"])
        rows = client_filters(first_seen(rows)) if spec.unique == "before" else first_seen(client_filters(rows))
        cols["native_id"] = F.col("native_id")
    else:
        rows = client_filters(rows)
    df = rows.select("seq", "pos", "raw", "board_company", *[c.alias(n) for n, c in cols.items()])
    df = df.select("*", *[c.cast(types[n]).alias(n) if n in types else c.alias(n) for n, c in late.items()])
    if query.remote_only:
        df = df.filter(F.col("remote"))
    names = [f.strip().split(" ")[0] for f in RAW_JOB.replace(SALARY, "salary_t").split(",")]
    return df.select(F.lit(spec.id).alias("engine"), "seq", "pos", *names)


def first_seen(df: DataFrame) -> DataFrame:
    """First record per native id.  The row limit per key is applied before the shuffle as well."""
    from pyspark.sql import Window

    order = Window.partitionBy("native_id").orderBy("seq", "pos")
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
