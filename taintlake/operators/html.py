"""HTML: inline scripts with their line offset, and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taintlake.rules.catalog import JS

INLINE_LABEL = "html (inline <script>)"
_INSIDE_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*+>"""
_PIECE = (rf"(?is)<!--.*?(?:-->|\z)|<script\b{_INSIDE_TAG}.*?(?:</script\s*>|\z)"
          rf"|<style\b{_INSIDE_TAG}.*?(?:</style\s*>|\z)|<[a-z/!?]{_INSIDE_TAG}|[^<]++|<")
_OPEN_TAG = rf"(?is)^<(?:script|style)\b{_INSIDE_TAG}"
_IN_TAG = (r"""(?s)<[/!?]?[\w:-]*+|[^\s=>"'/<]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"']++))?|\s++|.""")
_NAME = r"""^([^\s=>"'/<]++)"""
_VALUE = r"""(?s)=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']++))"""


def _pieces(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))


def _newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def scripts_of(content: Column) -> Column:
    """Script bodies with their line offset.  Pieces are walked once, counting line
    ends, and only scripts are kept."""
    def walk(state: Column, piece: Column) -> Column:
        head = F.regexp_extract(piece, _OPEN_TAG, 0)
        body = F.regexp_replace(F.substring(piece, F.length(head) + 1, F.length(piece)), r"(?i)</script\s*>$", "")
        is_script = F.lower(F.substring(piece, 1, 7)) == "<script"
        unit = F.struct((state["lines"] + _newlines(head)).alias("line_offset"), body.alias("content"))
        return F.struct(
            (state["lines"] + _newlines(piece)).alias("lines"),
            F.when(is_script & (F.length(head) > 0), F.array_append(state["found"], unit))
            .otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("lines"),
                     F.array().cast("array<struct<line_offset:int,content:string>>").alias("found"))
    return F.when(content.rlike(r"(?i)<script\b"), F.aggregate(_pieces(content), start, walk, lambda s: s["found"]))


def html_scripts(src_files: DataFrame) -> DataFrame:
    """Script bodies as JavaScript units of their file.  Row-local."""
    return (src_files.select("path", F.posexplode(scripts_of(F.col("content"))).alias("unit_no", "s"))
            .select("path", "unit_no", F.lit(JS).alias("lang"), F.lit(INLINE_LABEL).alias("out_lang"),
                    F.col("s.line_offset").alias("line_offset"), F.col("s.content").alias("content")))


def attrs_of(content: Column) -> Column:
    """Attributes of all tags as ``(pos, line, piece)``, in order."""
    def tag_parts(piece: Column) -> Column:
        head = F.regexp_extract(piece, _OPEN_TAG, 0)
        raw = F.length(head) > 0
        is_tag = piece.rlike(r"^<[A-Za-z?]")
        tag = F.when(raw, head).otherwise(piece)
        parts = F.transform(F.regexp_extract_all(tag, F.lit(_IN_TAG), F.lit(0)),
                            lambda x: F.struct(F.lit(True).alias("in_tag"), x.alias("piece")))
        rest = F.array(F.struct(F.lit(False).alias("in_tag"),
                                F.substring(piece, F.length(head) + 1, F.length(piece)).alias("piece")))
        whole = F.array(F.struct(F.lit(False).alias("in_tag"), piece.alias("piece")))
        return F.when(raw, F.concat(parts, rest)).when(is_tag, parts).otherwise(whole)

    def walk(state: Column, part: Column) -> Column:
        found = F.struct(state["pos"].alias("pos"), (state["lines"] + 1).alias("line"), part["piece"].alias("piece"))
        return F.struct(
            (state["pos"] + 1).alias("pos"), (state["lines"] + _newlines(part["piece"])).alias("lines"),
            F.when(part["in_tag"] & part["piece"].rlike(r"""^[^\s=>"'/<]"""), F.array_append(state["found"], found))
            .otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("lines"),
                     F.array().cast("array<struct<pos:int,line:int,piece:string>>").alias("found"))
    return F.aggregate(F.flatten(F.transform(_pieces(content), tag_parts)), start, walk, lambda x: x["found"])


def html_attrs(src_files: DataFrame) -> DataFrame:
    """Attributes ``(path, pos, line, attr, value, text)`` of all tags.  Row-local, as scripts are."""
    rows = src_files.select("path", F.explode(attrs_of(F.col("content"))).alias("x"))
    rows = rows.select("path", "x.pos", "x.line", "x.piece")
    piece = F.col("piece")
    value = F.concat(*[F.coalesce(F.regexp_extract(piece, _VALUE, i), F.lit("")) for i in (1, 2, 3)])
    return rows.select("path", "pos", "line", F.regexp_extract(piece, _NAME, 1).alias("attr"), value.alias("value"),
                       piece.alias("text"))


def uri_attrs(content: Column) -> Column:
    """Attributes with a ``javascript:`` address; null for a page without that word."""
    return F.when(content.rlike("(?i)javascript:"),
                  F.filter(attrs_of(content), lambda x: x["piece"].rlike("(?i)javascript:")))
