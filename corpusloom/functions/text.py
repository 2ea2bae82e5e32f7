"""Text, number and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.latex import latex_variables

# Hosts and marks of sites that recommendations must not point to.
PIRACY = ("libgen", "z-lib", "sci-hub", "bookfi", "b-ok", "pdfdrive")
SAFE_LINK = "https://openstax.org/"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def same_title(a: Column, b: Column) -> Column:
    """Equal but for case, white space around and dots at the end."""
    key = lambda c: F.lower(F.regexp_replace(strip(c), r"\.+$", ""))
    return key(a) == key(b)


def safe_int(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def safe_double(c: Column, default: float = 1.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp_enum(c: Column, values: list[str], default: str) -> Column:
    """Lower-cased and stripped, if it is one of the values; else the default."""
    v = F.lower(strip(c))
    return F.when(v.isin(*values), v).otherwise(F.lit(default))


def mask(c: Column) -> Column:
    """A secret of over four characters as `****...` and its last four."""
    return F.when(F.length(c) <= 4, c).otherwise(F.concat(F.lit("****..."), F.right(c, F.lit(4))))


def strip_fence(c: Column) -> Column:
    """The inside of a Markdown code fence, or the text stripped."""
    return strip(F.regexp_replace(strip(c), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def ensure_suffix(c: Column, suffix: str) -> Column:
    """With the suffix after a blank line, unless it is in the text already."""
    return F.when(F.contains(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit("\n\n" + suffix)))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_suffix(c: Column) -> Column:
    """Lower-cased file suffix of a url, its query and fragment left out; '' without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(c, r"^([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))


def url_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[A-Za-z0-9]+$", "")


def allowed_url(c: Column, blocked: list[str]) -> Column:
    """http or https, and a host that isn't blocked."""
    return c.rlike(r"^https?://") & ~url_host(c).isin(*blocked)


def safe_link(c: Column, fallback: str = SAFE_LINK) -> Column:
    """A link, or the fallback if it is empty or points to a piracy site."""
    bad = F.exists(F.array(*map(F.lit, PIRACY)), lambda p: F.contains(F.lower(c), p))
    return F.when(c.isNull() | (c == "") | bad, F.lit(fallback)).otherwise(c)


def path_title(c: Column) -> Column:
    """A file path as a title: its stem with spaces for underscores."""
    return F.replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z0-9]+$", ""), F.lit("_"), F.lit(" "))


def chunks_fixed(c: Column, size: int) -> Column:
    """Windows of `size` characters; an empty text has none. The text is read once."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), 0)


def chunks_paragraphs(c: Column, size: int) -> Column:
    """Chunks of at most `size` characters: what is left if it is no longer; else up to the last
    blank line that lies inside, if something stands before it; else `size` characters. A chunk
    starts where the last one ended. Empty texts have none; a text is read once, and each of
    its windows at most twice more."""
    before_blank = [rf".{{1,{size - 2}}}(?=\n\n)"] if size > 2 else []
    return F.regexp_extract_all(c, F.lit("(?s)" + "|".join([rf".{{1,{size}}}\z", *before_blank, f".{{1,{size}}}"])), 0)


def parse_equation(c: Column) -> Column:
    """struct(raw, variables, is_parseable); null isn't parseable."""
    return F.struct(F.coalesce(c, F.lit("")).alias("raw"), latex_variables(c).alias("variables"), c.isNotNull().alias("is_parseable"))


def parse_json(c: Column, schema: str) -> Column:
    """A struct of the schema, or null if the text (fence or not) isn't an object of it."""
    s = strip_fence(c)
    return F.when(F.try_parse_json(s).isNotNull() & s.startswith("{"), F.from_json(s, schema))


def parse_json_list(c: Column, item: str, wrappers: tuple[str, ...] = ("results", "items", "data")) -> Column:
    """An array from a JSON array, or from an object that wraps one; else an empty one."""
    s = strip_fence(c)
    ok = F.try_parse_json(s).isNotNull()
    wrapped = [F.from_json(F.get_json_object(s, f"$.{w}"), f"array<{item}>") for w in wrappers]
    return F.coalesce(F.when(ok & s.startswith("["), F.from_json(s, f"array<{item}>")), F.when(ok & s.startswith("{"), F.coalesce(*wrapped)), F.array().cast(f"array<{item}>"))
