"""Column helpers for text: decoding, stripping, splitting, snippets."""

from pyspark.sql import Column, functions as F

# ---- fixed values: what counts as white space / line end --------------------
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
SNIPPET_CHARS = 200


def strip(col: Column) -> Column:
    """Remove white space (all of Unicode's, not only blanks) on both sides."""
    return F.trim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def snippet(col: Column) -> Column:
    return F.substring(strip(col), 1, SNIPPET_CHARS)


def decode_lenient(col: Column) -> Column:
    """Bytes to text, dropping what is not UTF-8."""
    return F.replace(F.make_valid_utf8(col.cast("string")), F.lit("\ufffd"), F.lit(""))


def split_lines(col: Column) -> Column:
    """Array of lines without the empty element after a final line end."""
    parts = F.split(col, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def extension(file_name: Column) -> Column:
    """Lower-case extension with its dot; leading dots start no extension."""
    return F.lower(F.regexp_extract(file_name, r"^\.*[^.].*(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def place(engine: Column, unit: Column, index: Column, rule: Column) -> Column:
    """Order of a finding in its file, as ``seq``."""
    return F.struct(engine.cast("int").alias("engine"), unit.cast("long").alias("unit"), index.cast("long").alias("index"),
                    rule.cast("int").alias("rule")).alias("seq")
