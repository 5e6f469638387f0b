"""Text as Column expressions: junk, labels, frame names, recognizer answers and n-gram vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings that mean there is no text.
NO_TEXT = ("", "none", "null", "n/a", "no text", "[no text]", "<no_text>", "<no text>")
#: Frame names of two of the catalogues.
INDEXED_STEM, DIGIT_STEM = r"^(\d{6})_(\d{19})$", r"^\d+$"


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_junk(c: Column, min_length: int = 3, drop_numeric: bool = True) -> Column:
    """Too short, or digits alone; null counts as too short. Digits are those of any script
    (superscripts and other numerals are not)."""
    t = strip(F.coalesce(c, F.lit("")))
    short = F.length(t) < min_length
    return short | t.rlike(r"^\p{Nd}+$") if drop_numeric else short


def label_or_unknown(*candidates: Column) -> Column:
    """The first label given, stripped; ``unknown`` where it is null or blank."""
    t = strip(F.coalesce(*candidates))
    return F.when(t.isNull() | (t == ""), F.lit("unknown")).otherwise(t)


def fill_template(template: str, **names: str) -> str:
    """A path template with its names; a name it lacks, or one it has too many, is an error."""
    import string

    used = {f for _, f, _, _ in string.Formatter().parse(template) if f}
    if used != {*names}:
        raise ValueError(f"{template!r} uses {sorted(used)}, given are {sorted(names)}")
    return template.format(**names)


def camera_stem(camera: Column, stem: Column, primary: str) -> Column:
    return F.when(camera == primary, stem).otherwise(F.concat_ws("-", camera, stem))


def stem_camera(stem: Column, primary: str = "") -> Column:
    """The camera of a stem; ``primary`` where it names none."""
    return F.when(F.instr(stem, "-") > 0, F.substring_index(stem, "-", 1)).otherwise(F.lit(primary))


def stem_index(stem: Column) -> Column:
    return F.when(stem.rlike(INDEXED_STEM), F.regexp_extract(stem, INDEXED_STEM, 1).cast("bigint"))


def stem_stamp(stem: Column) -> Column:
    return F.when(stem.rlike(INDEXED_STEM), F.regexp_extract(stem, INDEXED_STEM, 2).cast("bigint"))


def seconds_to_ns(c: Column) -> Column:
    """Decimal seconds as text to nanoseconds, by digits and never through a float.

    More than nine decimals are cut off; a negative number keeps its sign for the whole seconds and its
    decimals are added. Anything else is null.
    """
    t = strip(c)
    whole = F.regexp_extract(t, r"^(-?\d+)(?:\.\d*)?$", 1)
    decimals = F.rpad(F.substring(F.regexp_extract(t, r"^-?\d+\.(\d*)$", 1), 1, 9), 9, "0")
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), whole.cast("bigint") * 1_000_000_000 + F.coalesce(F.try_to_number(decimals, F.lit("999999999")).cast("bigint"), F.lit(0)))


def ngram_buckets(c: Column, dim: int = 256, sizes: tuple[int, int] = (3, 5), lowercase: bool = True) -> Column:
    """Bucket of every character n-gram of ``<text>``, repeats kept; no bucket for a blank text."""
    t = strip(F.coalesce(c, F.lit("")))
    p = F.concat(F.lit("<"), F.lower(t) if lowercase else t, F.lit(">"))
    def grams(n: int) -> Column:
        bucket = lambda i: F.pmod(F.crc32(F.encode(F.substr(p, i, F.lit(n)), "utf-8")), F.lit(dim)).cast("int")
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), bucket)).otherwise(F.array().cast("array<int>"))

    return F.when(t == "", F.array().cast("array<int>")).otherwise(F.concat(*map(grams, range(sizes[0], sizes[1] + 1))))


def answer_array(c: Column) -> Column:
    """The first JSON array of objects in a recognizer's answer, as ARRAY<VARIANT>; null if there is none.

    Code fences and a comma before a closing bracket are forgiven.
    """
    t = F.regexp_replace(strip(c), r"^```(?:json)?\s*|\s*```$", "")
    t = F.regexp_replace(t, r",\s*\]", "]")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substr(t, i, F.lit(1)) == "[")
    whole = F.try_parse_json(t)
    listed = F.schema_of_variant(whole).rlike(r"^ARRAY<(OBJECT|VOID)")
    # of every "[" on, up to each "]": the shortest parse that is an array of objects
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substr(t, i, F.lit(1)) == "]")
    tried = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e > s), lambda e: F.substr(t, s, e - s + 1))))
    fits = F.filter(tried, lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).rlike(r"^ARRAY<(OBJECT|VOID)"), F.lit(False)))
    found = F.when(listed, whole).otherwise(F.try_parse_json(F.get(fits, F.lit(0))))
    return F.try_variant_get(found, "$", "array<variant>")


def answer_box(v: Column, path: str) -> Column:
    """A box in an answer: an array of four numbers or text like ``<box>a b c d</box>``; else null."""
    listed = F.try_variant_get(v, path, "array<double>")
    text = F.try_variant_get(v, path, "string")
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"^\s*(?:<box>)?\s*{number}\s+{number}\s+{number}\s+{number}\s*(?:</box>)?\s*$"
    written = F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, i).cast("double") for i in range(1, 5)]))
    whole = (F.size(listed) == 4) & ~F.exists(listed, lambda x: x.isNull())
    return F.when(whole, listed).otherwise(written)
