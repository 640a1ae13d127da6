"""Order-independent document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs: maximal runs without line end or sentence
end (`\\n \\r . ! ?`).  Each paragraph hashes to a wide vector; a text's fingerprint is
the sum of these vectors, each lane modulo a power of two.  So the order of paragraphs
doesn't matter, and one is added or taken away by adding or subtracting its vector.

Lanes: the number of paragraphs modulo 2^32; two sums of 30-bit values modulo 2^32;
and 60 one-bit lanes, three to a word of 60 bits at distances of 20, whose sums
(modulo 2^60 a word) estimate how many paragraphs two texts share: reading a bit as +1
or -1, the inner product of two sums estimates that of the multisets.  From 2^20 paragraphs
in one text on, the three sums of a word may carry into each other: the fingerprint and
its algebra stay exact, but near_edited and near_next are wrong for such a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintlake.llm.tables import range_of, range_starts

PARAGRAPH_END = r"[\n\r.!?]+"
WORDS = 20
_SPREAD = 1 | 1 << 20 | 1 << 40
_M60, _M32, _M20 = (1 << 60) - 1, (1 << 32) - 1, (1 << 20) - 1
RANGE_ROWS = 5_000


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _total(values: str, part: str, mask: int) -> str:
    return f"aggregate({values}, 0L, (s, h) -> (s + ({part})) & {mask}L)"


def lanes(text: str) -> Column:
    """array<long> for a text column: paragraphs, two dense sums, the words of bit lanes."""
    digest = f"transform(filter(split(coalesce({text}, ''), r'{PARAGRAPH_END}'), p -> p <> ''), p -> md5(p))"
    sums = [_total("b", f"h & {(1 << 30) - 1}L", _M32), _total("b", "shiftright(h, 30)", _M32)]
    sums += [_total("a", f"shiftright(h, {j}) & {_SPREAD}L", _M60) for j in range(WORDS)]
    first, second = (f"transform(d, m -> CAST(conv(substring(m, {at}, 15), 16, 10) AS BIGINT))" for at in (1, 16))
    vector = f"array(CAST(size(d) AS BIGINT), {', '.join(sums)})"
    return F.expr(_let(digest, "d", _let(first, "a", _let(second, "b", vector))))


def merged(a: str, b: str, sign: int = 1) -> Column:
    """Lanes after the paragraphs of b are added to (sign 1) or taken from (-1) a."""
    masks = f"concat(array_repeat({_M32}L, 3), array_repeat({_M60}L, {WORDS}))"
    return F.expr(f"zip_with(zip_with({a}, {b}, (x, y) -> x + {sign} * y), {masks}, (x, m) -> x & m)")


def shown(values: str) -> Column:
    """Lanes as one string of hexadecimal digits."""
    return F.expr(f"array_join(transform({values}, (x, i) -> lower(lpad(hex(x), if(i < 3, 8, 15), '0'))), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common paragraphs, 0 to 1; 1 for equal lanes."""

    def signed(v: str) -> str:
        counts = ", ".join(f"2 * (shiftright(w, {s}) & {_M20}L) - {v}[0]" for s in (0, 20, 40))
        return f"flatten(transform(slice({v}, 4, {WORDS}), w -> array({counts})))"

    def dot(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0L, (s, v) -> s + v)"

    share = _let(f"{dot('f', 'f')} + {dot('g', 'g')}", "n",
                 f"CASE WHEN n = 0 THEN 0D ELSE greatest(0D, least(1D, CAST(2 * {dot('f', 'g')} AS DOUBLE) / n)) END")
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE {_let(signed(a), 'f', _let(signed(b), 'g', share))} END")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with its fingerprint and that of an edited text, whose last
    quarter of code points is replaced by as many from the start of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null or empty text is the empty multiset; two of these
    are alike to 1.  Repeated doc_ids follow each other in the order of their texts.  A
    row without a doc_id has no next document: its next text is empty.  With a single
    document, that is its own next.  Other columns of `docs` are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts = range_starts(rows, "doc_id", RANGE_ROWS)
    # The first document of each range also closes the range before it, that of the
    # first range closes the last.
    home = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(64 + len(starts)))).otherwise(range_of(F.col("doc_id"), starts))
    leads = F.col("doc_id") == F.element_at(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.greatest(F.col("home"), F.lit(0)).cast("int") + 1)
    before = F.when(F.col("home") == 0, max(len(starts) - 1, 0)).otherwise(F.col("home") - 1)
    own = F.struct(F.col("home").alias("span"), F.lit(False).alias("guest"))
    both = F.array(own, F.struct(before.cast("long").alias("span"), F.lit(True).alias("guest")))
    placed = (rows.withColumn("home", home.cast("long")).withColumn("lanes", lanes("text"))
              .withColumn("place", F.explode(F.when((F.col("home") >= 0) & leads, both).otherwise(F.array(own))))
              .select("doc_id", "text", "lanes", "place.span", "place.guest"))
    order = Window.partitionBy("span").orderBy("guest", "doc_id", "text")
    lead = F.when(F.col("doc_id").isNotNull(), F.lead(F.struct("text", "lanes")).over(order))
    nexts = placed.withColumn("next", lead).where("NOT guest")
    none = F.array(*[F.lit(0).cast("long")] * (3 + WORDS))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")),
                      F.substring(F.coalesce(F.col("next.text"), F.lit("")), F.lit(1), quarter))
    ready = nexts.select("doc_id", "lanes", F.coalesce(F.col("next.lanes"), none).alias("next_lanes"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    ready = ready.withColumn("edited_lanes", lanes("edited"))
    return ready.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("lanes").alias("fingerprint"),
                        shown("edited_lanes").alias("edited_fingerprint"), likeness("lanes", "edited_lanes").alias("near_edited"),
                        likeness("lanes", "next_lanes").alias("near_next"))
