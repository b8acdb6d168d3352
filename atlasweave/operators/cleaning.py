"""Cleaning of whole records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.clergy import listed, matter
from ..stages import spread

#: What a cleaned record holds, all strings.
FIELDS = ("name", "jurisdiction", "diocese", "deanery", "city", "state", "zip", "country", "phone", "website", "lat", "lng", "address", "clergy", "source")


def clean_record(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """df with all FIELDS cleaned; columns that it lacks and coordinates out of range become '', further columns stay.

    A state or country inside the city moves to its own field. parish and detailUrl stand in for a missing name and website.
    aliases has usual names of jurisdictions by lower-case ones, those of the directory unless given.

    Steps are projections of their own, each over columns that the one before has made: a value that is named more than
    once is then computed once, and the plan's size is the sum of the steps' and not their product.
    """
    have = {c.lower() for c in df.columns}
    given = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) if c.lower() in have else F.lit(None).cast("string")
    also = {"name": "parish", "website": "detailUrl"}
    raw = lambda c: F.coalesce(given(c), *[given(also[c])] if c in also else [], F.lit(""))
    rest = [c for c in df.columns if c.lower() not in FIELDS]
    as_is = ("state", "country", "source")  # the first two are cleaned once the city has been looked at
    number = lambda c, limit: F.coalesce(text.coordinate(raw(c), limit).cast("string"), F.lit(""))
    inner = fresh(df, "__record")
    of = lambda c: F.col(f"{inner}.{c}")

    def step(rows: DataFrame, **made: Column) -> DataFrame:
        """rows with fields replaced or added."""
        kept = [c for c in rows.schema[inner].dataType.names if c not in made] if inner in rows.columns else []
        fields = F.struct(*[of(c).alias(c) for c in kept], *[v.alias(k) for k, v in made.items()])
        return rows.select(*[F.col(f"`{c}`") for c in rest], F.inline_outer(F.array(F.struct(fields.alias(inner)))))

    numbers = {"lat": 90.0, "lng": 180.0}
    rows = step(spread(df), **{c: number(c, numbers[c]) if c in numbers else raw(c) if c in as_is else text.clean(raw(c)) for c in FIELDS})
    rows = step(rows, parts=text.comma_parts(of("city")), website=text.with_scheme(of("website"), of("source")), clergy=matter(of("clergy")), name=text.unquoted(of("name")))
    rows = step(rows, place=text.places_of(of("city"), of("parts"), of("state"), of("country")), url=text.url_parts(of("website")))
    rows = step(rows, city=text.clean(of("place.city")), state=text.clean(of("place.state")), country=text.clean(of("place.country")), name=text.clean(of("name")))
    rows = step(rows, state=text.state_of(of("state")), website=text.rebuilt(of("website"), of("url")), clergy=listed(of("clergy")))
    made = {
        "jurisdiction": text.jurisdiction_of(of("jurisdiction"), of("source"), aliases),
        "zip": text.zip_of(of("zip")),
        "country": text.country_of(of("country"), of("state")),
        "phone": text.phone_of(of("phone")),
    }
    return rows.select(*[F.col(f"`{c}`") for c in rest], F.inline_outer(F.array(F.struct(*[made.get(c, of(c)).alias(c) for c in FIELDS]))))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
