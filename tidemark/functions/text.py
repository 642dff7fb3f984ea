"""Text functions as Column expressions. Everything here runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.vocabulary import (
    BOOLEAN_WORDS,
    EXTENSION_TYPES,
    NULL_WORDS,
    OCTET_STREAM,
    STATUS_WORDS,
    TRUE_WORDS,
)

# White space as str.isspace sees it: the Unicode class plus the four separators.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_NUMBER = r"-?\d+(?:\.\d+)?"

# windows-1252 bytes 0x80-0x9f (fixed values). Five of them are undefined.
_CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_map(values: dict[str, str]) -> Column:
    """Fixed text-to-text map as one literal expression."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(as_column(value), _EDGE_SPACE, "")


def clean_cell(value: Column | str) -> Column:
    """One-line cell text; a null cell is the empty string."""
    text = F.coalesce(as_column(value).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalize_header(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_column(value)), "[^a-z0-9]+", "")


def parse_numeric(value: Column | str) -> Column:
    """First number in the text as DOUBLE, null when there is none."""
    digits = F.regexp_extract(F.replace(as_column(value), F.lit(","), F.lit("")), _NUMBER, 0)
    return digits.try_cast("double")


def half_even(value: Column | str) -> Column:
    return F.rint(as_column(value)).cast("bigint")


def nullable(value: Column | str) -> Column:
    """Trimmed text, or null when it is blank or stands for "no value"."""
    words = "|".join(NULL_WORDS)
    named = F.regexp_replace(strip(as_column(value)), f"^(?i:{words})$", "")
    return F.nullif(named, F.lit(""))


def nullable_cell(cleaned: Column) -> Column:
    """`nullable` for text that is already clean: no second trim."""
    return F.when((cleaned != "") & ~F.lower(cleaned).isin(*NULL_WORDS), cleaned)


def non_empty(value: Column | str) -> Column:
    column = as_column(value)
    return F.when(column != "", column)


def first_non_empty(*values: Column | str) -> Column:
    return F.coalesce(*[non_empty(v) for v in values])


def status_word(value: Column | str) -> Column:
    """Allowed status for a known status word, null for any other text."""
    return F.try_element_at(literal_map(STATUS_WORDS), F.lower(strip(as_column(value))))


def any_token(text: Column, tokens: tuple[str, ...], whole_words: bool = False) -> Column:
    pattern = "|".join(tokens)
    return text.rlike(rf"\b({pattern})\b" if whole_words else pattern)


def normalize_lines(value: Column | str) -> Column:
    """Collapse blanks inside each line and drop the empty lines."""
    lines = F.split(as_column(value), _LINE_BREAK, -1)
    tidy = F.transform(lines, lambda line: strip(F.regexp_replace(line, "[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda line: line != ""), "\n")


def unquote(value: Column | str) -> Column:
    """Decode %xx escapes; a stray % and a + stay as they are."""
    text = as_column(value)
    escaped = F.replace(
        F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    return F.when(text.contains("%"), F.try_url_decode(escaped)).otherwise(text)


def shortened(text: Column, limit: int) -> Column:
    """Text of at most `limit` characters; what is cut is told apart by a hash at the end."""
    digest = F.substring(F.sha2(text, 256), 1, 16)
    cut = F.concat(F.substring(text, 1, limit - 17), F.lit("-"), digest)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def _sanitize(text: Column, forbidden: str, limit: int) -> Column:
    dashed = F.trim(F.regexp_replace(text, forbidden, "-"), F.lit("-"))
    return F.coalesce(non_empty(shortened(dashed, limit)), F.lit("unknown"))


def sanitize_key(value: Column | str, limit: int = 160) -> Column:
    """Key part of records and snapshots: unquoted first, `:` allowed."""
    return _sanitize(unquote(value), r"[^A-Za-z0-9\-_.=:]", limit)


def sanitize_path_part(value: Column | str) -> Column:
    """Part of a raw-document path: taken literally, no `:`."""
    return _sanitize(as_column(value), r"[^A-Za-z0-9\-_.=]", 160)


def safe_timestamp(value: Column | str) -> Column:
    return F.translate(as_column(value), ":.", "--")


def ascii_metadata(value: Column | str, max_len: int) -> Column:
    return F.substring(F.regexp_replace(as_column(value), r"[^\x00-\x7F]", ""), 1, max_len)


def media_type(content_type: Column | str) -> Column:
    """Media type without parameters, lower case; '' when absent."""
    text = F.coalesce(as_column(content_type), F.lit(""))
    return F.lower(strip(F.split_part(text, F.lit(";"), F.lit(1))))


def content_type(header: Column | str, url: Column | str, filename_hint: Column | str) -> Column:
    """Type named by the server, else guessed from the file name, else octet-stream."""
    declared = as_column(header)
    name = F.coalesce(as_column(filename_hint), as_column(url))
    # The query and fragment are not part of a file name.
    path = F.regexp_replace(name, r"[?#].*$", "")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.try_element_at(literal_map(EXTENSION_TYPES), extension)
    guessed = F.coalesce(known, F.lit(OCTET_STREAM))
    named = F.coalesce(
        non_empty(strip(F.split_part(declared, F.lit(";"), F.lit(1)))), F.lit(OCTET_STREAM)
    )
    return F.when(F.coalesce(declared, F.lit("")) != "", named).otherwise(guessed)


def truthy(value: Column | str, default: bool = True) -> Column:
    """Boolean spelled as text; null or empty takes the default."""
    text = as_column(value).cast("string")
    known = F.lower(strip(text)).isin(*TRUE_WORDS)
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(known)


def extra_value(value: Column | str) -> Column:
    """Extra catalog value: yes/no words become true/false, other text is trimmed."""
    text = strip(as_column(value))
    word = F.lower(text)
    as_bool = F.when(word.isin("true", "yes", "y"), "true").otherwise("false")
    return F.when(word.isin(*BOOLEAN_WORDS), as_bool).otherwise(text)


def iso_utc(value: Column | str) -> Column:
    """Timestamp as ISO-8601 with Z; the fraction appears only when there is one."""
    ts = as_column(value)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z")
    )


def looks_like_text(text: Column, sample_chars: int | None = None) -> Column:
    """At least 85 % printable or space, and no NUL; in the whole text, or its first characters."""
    sample = text if sample_chars is None else F.substring(text, 1, sample_chars)
    odd = F.length(
        F.regexp_replace(sample, r"[^\p{C}]|[\t\n\x0B\f\r\x1c-\x1f\x85]", "")
    )
    size = F.length(sample)
    return (size > 0) & ((size - odd) * 100 >= size * 85) & ~sample.contains("\x00")


def decode_text(content: Column | str) -> Column:
    """Bytes to text: UTF-8 (with or without mark), windows-1252, then latin-1.

    The first decoding that reads like text wins; latin-1 is the last resort.
    `windows-1252` is latin-1 with the bytes 0x80-0x9f replaced, which keeps the
    whole function a built-in expression.
    """
    data = as_column(content)
    raw = data.cast("string")
    utf8 = F.when(F.is_valid_utf8(raw), raw)
    unmarked = F.regexp_replace(utf8, r"^\x{FEFF}", "")
    latin = F.decode(data, "ISO-8859-1")
    cp1252 = F.when(
        ~latin.rlike(_CP1252_UNDEFINED), F.translate(latin, _CP1252_BYTES, _CP1252_CHARS)
    )
    return F.coalesce(
        F.when(looks_like_text(unmarked), unmarked),
        F.when(looks_like_text(utf8), utf8),
        F.when(looks_like_text(cp1252), cp1252),
        latin,
    )
