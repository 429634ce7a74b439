"""Text preparation: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P

# Every character that counts as a blank, as a pattern class and as plain characters.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What is not already a single space: replacing only this leaves most texts untouched.
_LOOSE_BLANKS = rf"{_BLANK}{{2,}}|{_BLANK.replace('x20', 'x1f')}"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Short task statements put before the post text of a batch-inference input row.
PROMPT_HEADS = {
    "en": "Read this Hebrew rental post and answer with one JSON object holding rooms, price, arnona, vaad, shelter, "
    "parking, entry_date, floor, elevator, is_agent and address; use null for anything not stated.\n---\n",
    "hebrew": "קרא את מודעת ההשכרה והחזר אובייקט JSON אחד עם rooms, price, arnona, vaad, shelter, parking, "
    "entry_date, floor, elevator, is_agent, address; ערך שלא צוין הוא null.\n---\n",
}
PROMPT_TAIL = "\n---\n"


def strip(col: Column) -> Column:
    """Remove blanks of every kind (tabs, newlines, no-break spaces) from both ends."""
    return F.btrim(col, F.lit(_BLANKS))


def any_contains(col: Column, words) -> Column:
    return reduce(Column.__or__, [F.contains(col, F.lit(w)) for w in words], F.lit(False))


def drop_direction_marks(col: Column) -> Column:
    """The pattern sees only texts with the bytes that every mark starts with in UTF-8, which are found far more cheaply."""
    raw = col.cast("binary")
    near = F.contains(raw, F.lit(b"\xe2\x80")) | F.contains(raw, F.lit(b"\xe2\x81"))
    return F.when(near, F.regexp_replace(col, P.DIRECTION_MARKS, "")).otherwise(col)


def with_post_text(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """The form of a post's text that every rule sees: no direction marks, no comment section."""
    kept = [c for c in rows.columns if c != (out or column)]
    unmarked, head = F.col("_unmarked"), F.col("_head")
    return (
        rows.withColumn("_unmarked", drop_direction_marks(F.col(column)))
        .withColumn("_head", F.regexp_replace(unmarked, rf"(?s)(?:{P.COMMENT_MARKERS}).*", ""))
        .select(*kept, F.when(F.length(head) < F.length(unmarked), strip(head)).otherwise(unmarked).alias(out or column))
    )


def long_enough(col: Column, min_chars: int) -> Column:
    return F.length(strip(col)) > min_chars


def model_input(col: Column) -> Column:
    """Post text as handed to an extraction model: no links, no blank lines, single blanks."""
    no_links = F.regexp_replace(col, P.LINKS.replace(r"\S", _BLANK.replace("[", "[^")), "")
    no_blank_lines = F.regexp_replace(no_links, r"\n{2,}", "\n")
    return strip(F.regexp_replace(no_blank_lines, r"[ \t]{2,}", " "))


def prompt(col: Column, params: P.ScreenParams) -> Column:
    """Batch-inference input: task statement, then the cleaned text, cut only where the caller gives a model's window."""
    head = PROMPT_HEADS["hebrew" if params.prompt_language == "hebrew" else "en"]
    body = model_input(col)
    if params.prompt_chars is not None:
        body = F.substring(body, 1, params.prompt_chars)
    return F.concat(F.lit(head), body, F.lit(PROMPT_TAIL))


def snippet(col: Column, chars: int = 100) -> Column:
    """One-line start of a text for audit output."""
    return F.translate(F.substring(col, 1, chars), "\n", " ")


def hebrew_only(col: Column) -> Column:
    """Keep Hebrew, digits, blanks and common punctuation; single blanks; no punctuation at the edges."""
    kept = F.regexp_replace(col, P.NOT_HEBREW, "")
    return F.btrim(F.regexp_replace(kept, rf"{_BLANK}{{2,}}", " "), F.lit(P.EDGE_PUNCTUATION))


def address_key(col: Column) -> Column:
    """City-free form of an address under which cross-posts meet; '' if there is none."""
    no_city = F.regexp_replace(col, P.CITY_TOKENS, "")
    no_punctuation = F.regexp_replace(no_city, P.ADDRESS_PUNCTUATION, " ")
    key = F.trim(F.regexp_replace(no_punctuation, _LOOSE_BLANKS, " "))
    return F.when(col.isNull() | (col == P.ADDRESS_UNSTATED), "").otherwise(key)


def cache_key(col: Column) -> Column:
    """Lookup key of an address: lower case, single blanks; NULL if nothing is left."""
    key = F.trim(F.regexp_replace(F.lower(col), _LOOSE_BLANKS, " "))
    return F.nullif(key, F.lit(""))


def repair_spelling(col: Column) -> Column:
    """Cut an address at a double underscore and mend its known misspellings."""
    fixed = F.split_part(col, F.lit("__"), F.lit(1))
    for pattern, replacement in P.SPELLING_REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return strip(fixed)


def anchored_address(col: Column) -> Column:
    """An address with the default region appended if it names no known city."""
    return F.when(any_contains(col, P.ANCHOR_CITIES), col).otherwise(F.concat(col, F.lit(P.ANCHOR_SUFFIX)))


def tri_state(col: Column) -> Column:
    """Yes, no or blank."""
    return F.when(col, P.YES_LABEL).when(~col, P.NO_LABEL).otherwise("")
