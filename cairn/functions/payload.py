"""Model answers and identifiers: JSON found in text, token usage, retry hints, point ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvaged(answer: Column) -> Column:
    """The JSON of a model's answer: in a fence, the whole answer, or between its outermost braces or brackets.

    Null where none of these is JSON.  The text is returned as it stands.
    """
    fenced = F.regexp_extract(answer, r"(?s)```(?:json|JSON)?[ \t]*\r?\n(.*?)\r?\n?[ \t]*```", 1)
    bare = F.regexp_replace(answer, r"^\s+|\s+$", "")
    outer = [F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.regexp_extract(answer, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*(F.when(t.rlike(r"^\s*[\[{]") & F.try_parse_json(t).isNotNull(), t) for t in (fenced, bare, *outer)))


def usage(body: Column) -> Column:
    """``struct<input_tokens, output_tokens, reasoning_tokens, total_tokens>`` out of a usage report of any of the known providers.

    Counts that a report leaves out are null; a missing total is the sum of what there is.
    """
    number = lambda *paths: F.coalesce(*(F.get_json_object(body, f"$.{p}").try_cast("long") for p in paths))
    read, wrote = number("input_tokens", "prompt_tokens", "promptTokenCount"), number("output_tokens", "completion_tokens", "candidatesTokenCount")
    thought = number("reasoning_tokens", "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens", "thoughtsTokenCount")
    total = F.coalesce(number("total_tokens", "totalTokenCount"), read + wrote, read, wrote)
    return F.struct(read.alias("input_tokens"), wrote.alias("output_tokens"), thought.alias("reasoning_tokens"), total.alias("total_tokens"))


def retry_after(value: Column, now_us: Column) -> Column:
    """Whole seconds to wait: of a number, of a duration such as ``12.5s`` (rounded up), or up to an HTTP date, not below 0.

    Null where the value is none of these.
    """
    text = F.trim(value)
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)s?$", 1)
    at = F.unix_micros(F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(number != "", F.ceil(number.try_cast("double")).cast("long")).when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.ceil((at - now_us) / 1_000_000).cast("long")))


def string_list(value: Column) -> Column:
    """A JSON array column as strings; null stays null, anything else that is no array of strings raises an error when read."""
    parsed = F.from_json(value, "array<string>")
    told = F.raise_error(F.concat(F.lit("not a JSON array: "), F.substring(value, 1, 80))).cast("array<string>")
    return F.when(value.isNull(), F.lit(None).cast("array<string>")).when(parsed.isNull() | ~F.trim(value).startswith("["), told).otherwise(parsed)


def point_id(ident: Column) -> Column:
    """The first 32 digits of the identifier's digest in the layout of a UUID."""
    h = F.sha2(ident, 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
