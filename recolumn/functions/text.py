"""String, date and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must agree with the published pipeline.
YEAR = r"(19|20)\d{2}"
RANKED_LINE = r"^\s*\d+\.\s*(.*?)(?:\s*\(\d{4}\))?$"
FENCE = r"(?s)^\s*```(?:\w+)?\s*(.*?)\s*```\s*$"


def stripped(text: Column) -> Column:
    """Without white space at the ends, all kinds of it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return text.isNotNull() & (stripped(text) != "")


def year(date: Column) -> Column:
    """First 19xx or 20xx; else the first four characters if they are a number from 1900 to 2100; else empty."""
    found = F.regexp_extract(date, YEAR, 0)
    head = F.when(F.substring(date, 1, 4).rlike(r"^\d{4}$"), F.substring(date, 1, 4).try_cast("int"))
    return F.when(date.isNull(), "").when(found != "", found).when(head.between(1900, 2100), head.cast("string")).otherwise("")


def ranked_title(line: Column) -> Column:
    """Title of `3. Title (1995)`; lines without a number keep their text; blank ones become null."""
    return F.nullif(F.when(line.rlike(RANKED_LINE), F.regexp_extract(line, RANKED_LINE, 1)).otherwise(stripped(line)), F.lit(""))


def title_key(title: Column) -> Column:
    """Lower case, letters, digits, underscore and white space only."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", "")


def letter_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct characters that b has."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0))


def clean_key(key: Column) -> Column:
    """First run of digits as a number, else null."""
    return F.nullif(F.regexp_extract(key, r"\d+", 0), F.lit("")).try_cast("long")


def clean_value(value: Column) -> Column:
    """A whole number, else null."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def unfenced(reply: Column) -> Column:
    """Inside of a code fence, else the reply without white space at its ends."""
    return F.when(reply.rlike(FENCE), F.regexp_extract(reply, FENCE, 1)).otherwise(stripped(reply))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def json_pairs(reply: Column) -> Column:
    """Array of (key, value) strings of a JSON object of scalars, in order; later keys come later."""
    return F.map_entries(F.from_json(reply, "map<string,string>"))


def ratings_map(reply: Column) -> Column:
    """Array of (item_id, rating): keys and values cleaned, unusable ones dropped, the last of equal keys kept."""
    pairs = F.transform(json_pairs(reply), lambda p: F.struct(clean_key(p["key"]).alias("item_id"), clean_value(p["value"]).alias("rating")))
    pairs = F.filter(pairs, lambda p: p["item_id"].isNotNull() & p["rating"].isNotNull())
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["item_id"] == p["item_id"]))


def reply_status(reply: Column) -> Column:
    """'ok', 'not_json' or 'bad_entry' of a ratings reply."""
    pairs = json_pairs(reply)
    bad = F.exists(pairs, lambda p: clean_key(p["key"]).isNull() | clean_value(p["value"]).isNull())
    return F.when(pairs.isNull(), "not_json").when(F.coalesce(bad, F.lit(True)), "bad_entry").otherwise("ok")


def missing_fields(reply: Column, *names: str) -> Column:
    """Required top-level fields that the JSON reply lacks."""
    return F.filter(F.array(*[F.when(F.get_json_object(reply, f"$.{n}").isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())
