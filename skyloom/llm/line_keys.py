"""Candidates of the segment-partition join: keys of lines as DataFrame rows, and what meets on them.

Every line gives its keys (lines.key_shapes). A key that no line holds as an own segment leads nowhere, so own
segments are marked in a table of bits first, whose rows are broadcast, and other keys stay where they were made
unless their bit is set. The table's size is fixed: with more lines it lets more keys pass, and the results are
the same. What passes is counted by key: a key of two rows names its pair at once, and only rows of keys with
more are gathered again. The lines of such a key are compared as they meet: the join makes a row of a close pair only,
so what is written grows with the keys and the links, not with the pairs that share a key.

Lines of hot keys meet by what they hold rather than by where: one edit changes four pairs of neighbouring
characters at most (a substitution takes two and adds two). Dealt into 4 * edits + 1 groups by hash, the pairs of
two close lines therefore agree in one whole group at least, and that group's digest is a key. Lines that differ
in some words agree in hardly any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialize

BASE = 0x9E3779B97F4A7C15
#: Bits of the table of own segments, and words of 64 bits in a row of it.
SLOTS, WORDS = 1 << 27, 16
#: Slots of the sieve for keys with more than two rows.
SIEVE = 1 << 20
#: Words of a line's signature.
SIGNS = 4
#: Counters of a line's characters.
COUNTS = 32
#: Characters whose counts tell most far lines of one key apart; the first few are compared first.
OFTEN, FIRST = " eatnoirshldcumwfgybpv.", 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def code_points(lines: list[str]) -> np.ndarray:
    """The characters of all lines, counted from 1."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def signatures(lines: list[str]) -> np.ndarray:
    """Two words of bits for each line (none of them empty): whether it holds an odd number of the pairs of neighbouring characters that hash to that bit.

    One edit changes four pairs at most (a substitution takes two and adds two), so lines at so many
    edits differ in four times as many bits at most.
    """
    points = code_points(lines)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    bit = mixed(points[:-1] * np.uint64(BASE) + points[1:]) >> np.uint64(57)
    flags = np.zeros((2, len(points)), np.uint64)
    flags[0, :-1] = np.where(bit < 64, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
    flags[1, :-1] = np.where(bit >= 64, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
    ends = np.cumsum(size)
    flags[:, ends - 1] = 0  # the last character of a line has no neighbour in it
    return np.bitwise_xor.reduceat(flags, ends - size, axis=1).view(np.int64)


def marks(lines: DataFrame, edits: int) -> DataFrame:
    """lines (h, line; h distinct): h, n, line, digests (of the groups of pairs of neighbouring characters), s0, s1 ..., a signature as in signatures, and counts of characters."""
    chars = F.split("line", "")
    after = F.slice(chars, F.lit(2), F.length("line") - 1)  # the last character's neighbour is null
    grams = F.zip_with(chars, after, lambda x, y: F.struct(F.xxhash64(x, y).alias("gram"), F.ascii(x).bitwiseAND(F.lit(COUNTS - 1)).alias("char")))
    each = lines.select("h", F.length("line").alias("n"), F.inline(grams))
    each = each.select("h", "n", "gram", "char", F.pmod("gram", F.lit(4 * edits + 1)).alias("group"), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(64 * SIGNS - 1)).cast("int").alias("bit"))
    digests = [F.coalesce(F.bit_xor(F.when(F.col("group") == k, F.col("gram"))), F.lit(0)).alias(f"g{k}") for k in range(4 * edits + 1)]
    bit = _bit(F.col("bit"))
    signs = [F.coalesce(F.bit_xor(F.when(F.shiftright("bit", 6) == k, bit)), F.lit(0)).alias(f"s{k}") for k in range(SIGNS)]
    found = each.groupBy("h", "n").agg(*digests, *signs, *[F.count_if(F.col("char") == k).cast("int").alias(f"c{k}") for k in range(COUNTS)])
    found = found.select("h", "n", F.array(*[f"g{k}" for k in range(4 * edits + 1)]).alias("digests"), *[f"s{k}" for k in range(SIGNS)], F.array(*[f"c{k}" for k in range(COUNTS)]).alias("counts"))
    return found.join(lines.select("h", "line"), "h")


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by its keys over as many tasks as shuffles have, however few bytes it holds: comparing takes time, not room."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _ordered(met: DataFrame, x: str, y: str, texts) -> DataFrame:
    """Pairs (a, b), a being the lesser hash; with texts also their lines x and y, in any order."""
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *([F.col(x).alias("x"), F.col(y).alias("y")] if texts else []))


def _range(edits: int) -> Column:
    """Lengths n of close lines fall into one range or two neighbouring ones."""
    return F.floor(F.col("n") / (edits + 1)).cast("int")


def hot_stars(marked: DataFrame, edits: int) -> DataFrame:
    """marked (of marks): pairs (a, b) of each line and the least one, b, of those with one of its digests and lengths in its range; as many for a line as there are digests at most."""
    own = marked.select("h", _range(edits).alias("range"), F.posexplode("digests").alias("group", "digest"))
    least = own.groupBy("group", "digest", "range").agg(F.min("h").alias("b"), F.count("*").alias("m")).where("m > 2").drop("m")
    return own.join(least, ["group", "digest", "range"]).where("h <> b").select(F.col("h").alias("a"), "b").distinct()


def starred(marked: DataFrame, stars: DataFrame) -> DataFrame:
    """marked with star, the least b that stars (a, b) link a line with, or the line itself: lines of one star are linked already."""
    return marked.join(stars.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("star")), "h", "left").withColumn("star", F.coalesce("star", "h"))


def hot_pairs(marked: DataFrame, edits: int, close=None) -> DataFrame:
    """marked (of marks or starred): pairs (a, b) that may be within the edits, each once, at the first group in which they agree; without those of one star, and with close(x, y) on the lines x and y only those that are, with their lines."""
    size = _range(edits)
    marked = marked if "star" in marked.columns else marked.withColumn("star", F.col("h"))
    own = marked.select("*", F.posexplode("digests").alias("group", "digest"))
    names = lambda h, n, digests, counts, sign, line: [F.col("h").alias(h), F.col("star").alias(f"{h}_star"), F.col("n").alias(n), F.col("digests").alias(digests), F.col("counts").alias(counts), *[F.col(f"s{k}").alias(f"{sign}{k}") for k in range(SIGNS)], *([F.col("line").alias(line)] if close else [])]
    left = own.select("group", "digest", size.alias("range"), *names("a", "p", "x", "u", "x", "xs"))
    right = own.select("group", "digest", F.explode(F.array(size - 1, size)).alias("range"), *names("b", "q", "y", "v", "y", "ys"))
    shorter = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("a") < F.col("b")))
    differ = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(SIGNS)), F.lit(0))
    first = F.lit(True)
    for k in range(4 * edits):
        first = first & ((F.col("group") <= k) | (F.get("x", F.lit(k)) != F.get("y", F.lit(k))))
    # an edit changes two counts by one at most
    moved = sum((F.abs(F.get("u", F.lit(k)) - F.get("v", F.lit(k))) for k in range(COUNTS)), F.lit(0))
    keys = ["group", "digest", "range"]
    near = shorter & (F.col("a_star") != F.col("b_star")) & (F.col("q") - F.col("p") <= edits) & (differ <= 4 * edits) & first & (moved <= 2 * edits)
    met = _spread(left, *keys).join(_spread(right, *keys), keys).where(near & close(F.col("xs"), F.col("ys")) if close else near)
    return _ordered(met, "xs", "ys", close)


def segment(length: Column, i: Column | int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 0) of a line: equal sizes, the last ones longer by one."""
    i = F.lit(i) if isinstance(i, int) else i
    long = length % (edits + 1)
    base = ((length - long) / (edits + 1)).cast("int")
    short = (edits + 1) - long
    return base * i + F.greatest(i - short, F.lit(0)) + 1, base + (i >= short).cast("int")


def shape_rows(shapes: list[tuple[int, int, int]]) -> Column:
    """Shapes as an array of structs: j, which counts them, i, less and offset."""
    return F.array(*[F.struct(F.lit(j).cast("byte").alias("j"), F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(offset).alias("offset")) for j, (i, less, offset) in enumerate(shapes)])


def keyed(lines: DataFrame, shapes: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """h, j and key for each shape of each line (h, line).

    The shapes are exploded before their keys are made, so that the code that makes one is short enough to be compiled.
    Where each character is a byte, keys are cut from the bytes, which need not be walked up to the place; they are the same.
    """
    plain = F.octet_length("line") == F.length("line")
    each = lines.select("h", F.when(plain, F.col("line").cast("binary")).alias("bytes"), F.when(~plain, F.col("line")).alias("line"), F.length("line").alias("length")).select("*", F.inline(shape_rows(shapes)))
    start, size = segment(F.col("length") - F.col("less"), F.col("i"), edits)
    key = lambda x: F.xxhash64(F.col(x).substr(start + F.col("offset"), size), F.col("length") - F.col("less"), F.col("i"))
    return each.select("h", "j", F.when(F.col("bytes").isNotNull(), key("bytes")).otherwise(key("line")).alias("key"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _places(key: Column) -> tuple[Column, list[tuple[Column, Column]]]:
    """A key's row in the table of bits, and word and bit of its two places there."""
    place = lambda low: (F.shiftright(key, low + 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"), _bit(F.shiftright(key, low)))
    return F.shiftright(key.bitwiseAND(F.lit(SLOTS - 1)), 10), [place(0), place(32)]


def bits(own: DataFrame) -> DataFrame:
    """own (key): row and words, the table of bits of all keys; of a fixed size, whatever the data are."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = own.select(_places(F.col("key"))[0].alias("row"), "key").repartition(parts, "row")
    (word, bit), (other, more) = _places(F.col("key"))[1]
    each = each.select("row", word.alias("word"), bit.alias("bit"), other.alias("other"), more.alias("more"))
    held = lambda k: F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0)).bitwiseOR(F.when(F.col("other") == k, F.col("more")).otherwise(F.lit(0))))
    words = each.groupBy("row").agg(*[held(k).alias(f"w{k}") for k in range(WORDS)])
    return words.select("row", F.array(*[f"w{k}" for k in range(WORDS)]).alias("words"))


def _sieved(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df whose key may be among keys (key)."""
    slot = F.pmod("key", F.lit(SIEVE))
    return df.join(F.broadcast(keys.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")


def candidates(lines: DataFrame, shapes: list[tuple[int, int, int]], edits: int, hot_key: int, buffer: int | None = None) -> DataFrame:
    """lines (h, line; repeats allowed): a pair (a, b) of hashes that are alone with a key, or a line h of a key with more lines and whether it holds the key as an own segment, or a line h of a key with over hot_key lines, and its shape j. buffer is not used."""
    table = materialize(bits(keyed(lines, shapes[: edits + 1], edits)), "line-bits")
    row, ((word, bit), (other, more)) = _places(F.col("key"))
    likely = keyed(lines, shapes, edits).join(F.broadcast(table), row == F.col("row")).where((F.get("words", word).bitwiseAND(bit) != 0) & (F.get("words", other).bitwiseAND(more) != 0))
    rows = materialize(likely.select("key", "h", "j"), "line-keys")
    met = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"), F.count_if(F.col("j") <= edits).alias("owned"))
    met = materialize(met.where("a <> b and owned > 0").drop("owned"), "line-met")
    many = met.where("n > 2").select("key")
    rows = materialize(_sieved(rows, many).join(many, "key").distinct(), "line-groups")
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "line-counts")
    hot = rows.join(counts.where(F.col("n") > hot_key).select("key"), "key")
    few = rows.join(counts.where(F.col("n") <= hot_key).select("key"), "key")
    few = few.groupBy("key", "h").agg((F.min("j") <= edits).alias("own"))
    alone = met.where("n = 2").select("a", "b").distinct()
    types = {"a": "long", "b": "long", "key": "long", "j": "byte", "h": "long", "own": "boolean"}
    filled = lambda df: df.select(*[F.col(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in types.items()])
    return filled(alone).union(filled(few)).union(filled(hot.select("key", "j", "h")))


def alone(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that no third one shared their key with; at most one for each key."""
    return found.where("a is not null").select("a", "b").distinct()


def counted(lines: DataFrame) -> DataFrame:
    """lines (line) with how often each holds the characters of OFTEN, which are bytes, so bytes are counted."""
    return lines.select("*", *[(F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(x), F.lit("")))).alias(f"_{k}") for k, x in enumerate(OFTEN)])


def group_pairs(found: DataFrame, known: DataFrame | None = None, close=None, edits: int = 3) -> DataFrame:
    """Pairs (a, b) of lines of one key that more lines have, hot_key at most, repeated; with close(x, y) on the lines of known (h, line; or of counted), only those within the edits, with their lines x and y."""
    few = found.where("own is not null").select("key", "h", "own")
    few = few.join(known if "_0" in known.columns else counted(known.select("h", "line")), "h") if close else few
    text = lambda name: [F.col("line").alias(name), *[F.col(f"_{k}").alias(f"{name}{k}") for k in range(len(OFTEN))]] if close else []
    left = few.where("own").select("key", F.col("h").alias("a"), *text("x"))
    right = few.select("key", F.col("h").alias("b"), "own", *text("y"))
    # an edit changes two counts by one at most
    moved = lambda most: sum((F.abs(F.col(f"x{k}") - F.col(f"y{k}")) for k in range(most)), F.lit(0)) <= 2 * edits
    met = F.expr("a <> b and (not own or a < b)")
    met = met & moved(FIRST) & moved(len(OFTEN)) if close else met
    met = _spread(left, "key").join(_spread(right, "key"), "key").where(met & close(F.col("x"), F.col("y")) if close else met)
    return _ordered(met, "x", "y", close)


def pairs(found: DataFrame) -> DataFrame:
    """All pairs (a, b) of lines that share a key, each once, without those of hot keys."""
    return alone(found).union(group_pairs(found)).distinct()


def hot_lines(found: DataFrame) -> DataFrame:
    return found.where("j is not null").select("key", "j", "h").distinct()


def in_need(found: DataFrame) -> DataFrame:
    """The hashes (h) of all lines that found names, repeated."""
    return found.select(F.explode(F.filter(F.array("a", "b", "h"), lambda x: x.isNotNull())).alias("h"))
