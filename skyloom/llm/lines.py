"""Line dedup by a segment-partition edit join.

Lines are compared trimmed and in lower case; two are linked at so many edits or fewer, and linked
lines form classes. A line of length l is split into edits + 1 segments; a line within the edits holds one
of them whole, near where it stood. So every distinct line gives its own segments as index keys and, for
each length from its own down to edits less, those of its substrings that could be such a segment as
probe keys. Lines that share a key are candidates (module line_keys); they are verified by a banded
bit-parallel edit distance as column expressions. All is DataFrame operations.

A key with more than hot_key lines would give many pairs. At more than one edit such lines meet by digests of groups
of their pairs of neighbouring characters instead, of which close lines share one at least, and only where signatures
and counts of characters allow so many edits (line_keys.hot_pairs). Before that each is compared with the least line of
its digests; lines that are linked to the same one need not meet, so a group of near copies costs as many links as it has lines.
At one edit such lines are told apart exactly without pairs: the rest of two such lines differs by one substitution, then both give the same
string with that place left out, or by one insertion, then one is the other with a place left out; what
meets on such a string is linked to its least member.

Of a class, the document with the smallest identifier keeps its lines. Elsewhere the class's lines are
dropped, unless such lines make up more than max_share of a document: that is a copy, which document
dedup is to judge. Within any document only the first line of a class stays.

Lines under min_chars characters are too short for useful segments: those of exact_chars or more
form classes of equal lines.

Defined results: null and empty texts have no lines to drop; lines under exact_chars (min_chars unless
given) are never dropped; a null identifier sorts after all others, and documents with null identifiers only keep their
lines; rows that agree in identifier and text share one decision; an empty table gives an empty one;
other columns are carried unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import line_keys
from skyloom.llm.common import fresh, join_unique, materialize
from skyloom.llm.graph import components

BREAK = "\n"
#: Slots of the broadcast sieve that keeps most texts without candidates from moving.
SIEVE = 1 << 22
#: What op8 and the pipeline use: three edits, short lines whole, repeats dropped whatever their share.
WHOLE = {"edits": 3, "exact_chars": 1, "max_share": 1.0}


def let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """The Levenshtein distance of two strings if it is most or less, else something above; for lengths that differ by most or less.

    A column of the table of distances is two words of bits, the steps up and down along a band of
    2 * most + 1 rows; a character of b moves the band down by one row. The distance is kept at the band's
    lowest row until that is the last row of a, and then along that row.
    """
    width = 2 * most + 1
    full = F.lit((1 << width) - 1).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda x, i: F.shiftrightunsigned(x, i).bitwiseAND(one) if isinstance(i, int) else F.call_function("shiftrightunsigned", x, i).bitwiseAND(one)
    flip = lambda x: F.bitwise_not(x).bitwiseAND(full)

    def run(c: Column) -> Column:
        pattern, text = c["p"], c["t"]
        m = F.size(pattern)

        def step(state: Column, j: Column) -> Column:
            at = F.get(text, j - 1)
            eq = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(pattern, j - most + i - 1) == at, F.lit(1 << i).cast("long")).otherwise(zero) for i in range(width)])
            up, down = state["up"], state["down"]
            diagonal = lambda e: ((e.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(e).bitwiseOR(down).bitwiseAND(full)

            def rows(d: Column) -> Column:
                right = down.bitwiseOR(flip(d.bitwiseOR(up)))
                left = d.bitwiseAND(up)
                low = F.shiftrightunsigned(d, 1)
                row = m - j + most
                last = state["score"] + (bit(right, row) - bit(left, row)).cast("int")
                score = F.when(j <= m - most, state["score"] + (one - bit(d, width - 1)).cast("int")).otherwise(last)
                return F.struct(left.bitwiseOR(flip(low.bitwiseOR(right))).alias("up"), low.bitwiseAND(right).alias("down"), score.alias("score"))

            return let(let(eq, diagonal), rows)

        start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("up"), zero.alias("down"), F.least(F.lit(most), m).alias("score"))
        return F.when(F.size(text) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(text), F.lit(1))), start, step, lambda s: s["score"])).otherwise(m)

    chars = lambda x: F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    alike = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)) - 1

    def middle(c: Column) -> Column:
        """The characters between what both begin and both end with, which no shortest way of edits touches."""
        p, t = c["p"], c["t"]
        least = F.least(F.size(p), F.size(t))

        def cut(head: Column) -> Column:
            tail = F.least(alike(F.reverse(p), F.reverse(t)), least - head)
            return let(tail, lambda y: F.struct(*[F.slice(x, head.cast("int") + 1, (F.size(x) - head - y).cast("int")).alias(n) for x, n in ((p, "p"), (t, "t"))]))

        return let(alike(p, t), cut)

    return F.when(a == b, F.lit(0)).otherwise(let(let(F.struct(chars(a).alias("p"), chars(b).alias("t")), middle), run))


def without_ends(a: Column, b: Column, halvings: int = 7) -> Column:
    """Struct (p, t, n): a and b without most of what both begin and both end with, which changes no distance between them.

    Ends of half the shorter length, a quarter and so on go where they are equal.
    """
    sized = lambda p, t: F.struct(p.alias("p"), t.alias("t"), F.least(F.length(p), F.length(t)).alias("n"))

    def shorten(k: int, end, rest):
        def cut(c: Column) -> Column:
            size = F.shiftright(c["n"], k)
            shorter = F.struct(*[rest(c[x], size).alias(x) for x in "pt"], c["n"].alias("n"))
            return F.when(end(c["p"], size) == end(c["t"], size), shorter).otherwise(c)

        return cut

    out = sized(a, b)
    for k in range(1, halvings + 1):
        out = let(out, shorten(k, F.left, lambda x, size: F.substr(x, size + 1)))
    out = let(out, lambda c: sized(c["p"], c["t"]))
    for k in range(1, halvings + 1):
        out = let(out, shorten(k, F.right, lambda x, size: F.left(x, F.length(x) - size)))
    return out


def key_shapes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, length less than the line's own by, offset) of a line's keys; those of its own segments come first, by segment."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            out += [(i, less, offset) for offset in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)]
    return sorted(out, key=lambda x: x[1:] != (0, 0))


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, ih and th (which name the document), at, n, line and h for each line of min_chars or more."""
    text, doc_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    each = docs.select(doc_id.alias("id"), id_hash(doc_id).alias("ih"), F.xxhash64(text).alias("th"), text.alias("text"))
    each = each.select("id", "ih", "th", F.posexplode(F.split("text", BREAK)).alias("at", "raw"))
    each = each.select("id", "ih", "th", "at", F.lower(F.trim("raw")).alias("line"))
    return each.where(F.length("line") >= min_chars).select("*", F.length("line").alias("n"), F.xxhash64("line").alias("h"))


def id_hash(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")))


def _hot_links(hot: DataFrame) -> DataFrame:
    """hot (key, segment, less, h, n, line) at one edit: edges (a, b)."""
    start, size = line_keys.segment(F.col("n") - F.col("less"), 1, 1)
    rest = F.when(F.col("segment") == 0, F.col("line").substr(start, size + F.col("less"))).otherwise(F.col("line").substr(F.lit(1), start - 1 + F.col("less")))
    cut = hot.select("key", "less", "h", rest.alias("rest"))
    without = lambda p: F.concat(F.substr("rest", F.lit(1), p - 1), F.substr("rest", p + 1))
    places = F.sequence(F.lit(1), F.length("rest"))
    replaced = F.transform(places, lambda p: F.xxhash64(without(p), p))
    removed = F.transform(places, lambda p: F.xxhash64(without(p), F.lit(0)))
    same = F.array(F.xxhash64("rest", F.lit(0)))
    variants = cut.where(F.length("rest") > 0).select("key", "less", "h", F.explode(F.when(F.col("less") == 0, F.concat(replaced, same)).otherwise(F.array_distinct(removed))).alias("variant"))
    centre = variants.groupBy("key", "variant").agg(F.min(F.when(F.col("less") == 0, F.col("h"))).alias("b"), F.count("*").alias("m")).where("m > 1 and b is not null")
    return variants.join(centre, ["key", "variant"]).where("h <> b").select(F.col("h").alias("a"), "b")


def close_lines(x: Column, y: Column, edits: int) -> Column:
    """Whether two lines are within the edits, by compiled code; its time grows with the square of the length of what is left without the ends."""
    return (F.abs(F.length(x) - F.length(y)) <= edits) & (let(without_ends(x, y), lambda c: F.levenshtein(c["p"], c["t"], edits)) >= 0)


def _met(pairs: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """Those of the pairs (a, b) of hashes of lines of known that are close, with their lines x and y."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.join(known.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").repartition(parts, "b")
    pairs = pairs.join(known.select(F.col("h").alias("b"), F.col("line").alias("y")).repartition(parts, "b"), "b")
    return pairs.where(close_lines(F.col("x"), F.col("y"), edits)).select("a", "b", "x", "y")


def _verified(met: DataFrame, edits: int) -> DataFrame:
    """met (a, b, x, y; repeats allowed): edges (a, b). It is written first, so that the few pairs left, and not each join, run the columns of the distance."""
    return materialize(met.dropDuplicates(["a", "b"]), "line-close").where(edit_distance(F.col("x"), F.col("y"), edits) <= edits).select("a", "b")


def line_links(lines: DataFrame, edits: int, hot_key: int) -> DataFrame:
    """Edges (a, b) between the hashes h of lines (h, line; repeats allowed)."""
    found = materialize(line_keys.candidates(lines, key_shapes(edits), edits, hot_key), "line-candidates")
    need = materialize(line_keys.in_need(found).distinct(), "line-need")
    slot = F.pmod("h", F.lit(SIEVE))
    sieve = need.select(slot.alias("slot")).distinct()  # SIEVE rows at most, whatever the data are
    likely = lines.select("h", "line").join(F.broadcast(sieve), slot == F.col("slot"), "left_semi")
    known = materialize(likely.join(need, "h").dropDuplicates(["h"]), "line-texts")
    close = lambda x, y: close_lines(x, y, edits)
    counted = materialize(line_keys.counted(known), "line-counted")
    met = _met(line_keys.alone(found), known, edits).union(line_keys.group_pairs(found, counted, close, edits))
    hot = line_keys.hot_lines(found)
    if edits != 1:
        marked = materialize(line_keys.marks(known.join(hot.select("h").distinct(), "h"), edits), "line-marks")
        stars = _verified(_met(line_keys.hot_stars(marked, edits), known, edits), edits)
        return stars.union(_verified(met.union(line_keys.hot_pairs(line_keys.starred(marked, stars), edits, close)), edits))
    shape = F.get(line_keys.shape_rows(key_shapes(edits)), F.col("j").cast("int"))
    hot = hot.select("key", "h", shape["i"].alias("segment"), shape["less"].alias("less")).join(known.select("h", "line", F.length("line").alias("n")), "h")
    return _verified(met, edits).union(_hot_links(hot))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = 24, max_share: float = 0.5, hot_key: int = 64, exact_chars: int | None = None) -> DataFrame:
    """ih, th and dropped, the sorted numbers of lines to drop (from 0), for documents that lose lines."""
    if not 0 < edits * 2 + 2 < min_chars:
        raise ValueError("lines must be longer than twice the segments")
    lines = lines_of(docs, id_col, text_col, min_chars if exact_chars is None else exact_chars)
    all_ = materialize(lines, "lines")
    distinct = materialize(all_.groupBy("h").agg(F.count("*").alias("times"), F.min("id").alias("least")), "distinct-lines")
    roots = components(line_links(all_.where(F.col("n") >= min_chars), edits, hot_key))
    linked = materialize(roots.withColumnRenamed("node", "h").join(distinct.select("h", "least", F.col("times").alias("n")), "h"), "line-classes")
    owners = linked.groupBy("root").agg(F.min("least").alias("owner"))
    again = linked.join(owners, "root").select("h", F.col("root").alias("class"), "owner", "n")
    more = distinct.where("times > 1").join(again, "h", "left_anti").select("h", F.col("h").alias("class"), F.col("least").alias("owner"), F.col("times").alias("n"))
    classes = materialize(again.union(more), "line-names")
    seen = join_unique(all_.select("id", "ih", "th", "at", F.col("n").alias("chars"), "h"), classes, "h", all_.count())
    firsts = seen.groupBy("ih", "th", "class").agg(F.min("at").alias("first"))
    seen = seen.join(firsts, ["ih", "th", "class"])
    foreign = ~F.col("id").eqNullSafe(F.col("owner"))
    repeat = F.col("at") > F.col("first")
    per_doc = seen.groupBy("ih", "th").agg(
        F.sum(F.when(foreign, F.col("chars")).otherwise(0)).alias("foreign_chars"), F.collect_set(F.when(repeat, F.col("at"))).alias("repeats"), F.collect_set(F.when(foreign, F.col("at"))).alias("foreigns")
    )
    sizes = all_.groupBy("ih", "th").agg(F.sum("n").alias("chars"))
    drop = F.when(F.col("foreign_chars") <= F.col("chars") * max_share, F.array_union("repeats", "foreigns")).otherwise(F.col("repeats"))
    return per_doc.join(sizes, ["ih", "th"]).select("ih", "th", F.sort_array(drop).alias("dropped")).where(F.size("dropped") > 0)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (the numbers of dropped lines, comma-joined) of every document."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), id_hash(F.col(f"`{id_col}`")).alias("ih"), F.xxhash64(text).alias("th"), F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(BREAK), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = slim.join(line_decisions(docs, id_col, text_col, **options), ["ih", "th"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the dropped lines taken out of their texts."""
    ih, th, dropped, ih2, th2 = fresh(docs.columns, "ih", "th", "dropped", "ih_of", "th_of")
    text = F.col(f"`{text_col}`").cast("string")
    found = line_decisions(docs, id_col, text_col, **options).select(F.col("ih").alias(ih2), F.col("th").alias(th2), F.col("dropped").alias(dropped))
    keyed = docs.select("*", id_hash(F.col(f"`{id_col}`")).alias(ih), F.xxhash64(text).alias(th))
    joined = keyed.join(found, (F.col(ih) == F.col(ih2)) & (F.col(th) == F.col(th2)), "left")
    kept = F.array_join(F.filter(F.split(text, BREAK), lambda x, i: ~F.array_contains(F.col(dropped), i)), BREAK)
    return joined.select(*[F.when(F.col(dropped).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
