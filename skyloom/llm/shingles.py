"""Near copies by SimHash fingerprints and by exact similarity of shingle sets: the pipeline's document dedup.

With fingerprints, documents are linked as op2 links them (module simhash), and by the similarity below, which finds
copies with more changes; components are those of both kinds of links together.

A text is the set of its runs of five words (simhash.shingle_digests); two texts are near copies if
their sets have a Jaccard similarity of 0.8 or more, and linked texts form components. Texts of equal
sets are one. Candidates share a band, four of 128 min-hashes, in one of 32 bands; a pair at 0.8 is
missed with a probability of 5e-8, and every candidate is verified on its whole sets.

A band with more than PAIRS texts does not make all its pairs: its texts are compared with its least
one first. Then only those outside its largest component are compared with all texts of another
component, since two of one component need no comparison, and only where sizes and signatures allow the
similarity: sets of p and q shingles at 0.8 differ in (p + q) / 9 at most. The components are those of all pairs.

Defined results: null, empty and blank texts have the empty set and are copies of each other; rows with
a null identifier never name a component with others in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import join_unique, materialize
from skyloom.llm.graph import components
from skyloom.llm.lines import SIEVE
from skyloom.llm.simhash import keep_one, near_duplicates, shingle_digests

WORDS = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
ROWS, BANDS = 4, 32
PAIRS = 16
#: Words of 64 bits of a set's signature.
SIGNS = 8
#: Shingles that are hashed at a time.
SLICE = 256
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64, endpoint=False) | np.array([[1], [0]], np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, WORDS)), ">u8").astype(np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), SLICE):
        least = np.minimum(least, (own[low : low + SLICE, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def signature(own: np.ndarray) -> list[int]:
    """SIGNS words of bits: whether the set holds an odd number of the shingles that hash to that bit. Sets differ in as many shingles at least as their signatures in bits."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * SIGNS), minlength=64 * SIGNS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, own (the hash of the shingle set), size (of the set), keys (of its bands) and signs (its signature)."""
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", long), T.StructField("own", long), T.StructField("size", long), T.StructField("keys", T.ArrayType(long)), T.StructField("signs", T.ArrayType(long))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                found = shingle_set(x.as_py() or b"")
                out.append((xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), len(found), band_keys(found) if len(found) else [], signature(found)))
            own, size, keys, signs = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))], names=schema.names)

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`"), F.xxhash64(text), text.cast("binary")).mapInArrow(run, schema)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(64)(shingle_set)
    for batch in batches:
        same = [similar(known(x.as_py()), known(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))


def links(sets: DataFrame, texts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """sets: own (distinct), text_hash, size, keys, signs; texts: text_hash, text. Edges (a, b) that connect whatever similar candidates connect."""
    keyed = sets.select("own", "text_hash", "size", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("m"), F.min("own").alias("first")).where("n > 1")
    members = materialize(join_unique(keyed, materialize(met, "shingle-met"), "key", keyed.count()), "shingle-bands")
    need = materialize(members.select("own", "text_hash").distinct(), "shingle-need")
    sieve = need.select(F.pmod("text_hash", F.lit(SIEVE)).alias("slot")).distinct()  # SIEVE rows at most, whatever the data are
    likely = texts.join(F.broadcast(sieve), F.pmod("text_hash", F.lit(SIEVE)) == F.col("slot"), "left_semi")
    known = materialize(likely.join(need, "text_hash").select("own", F.col("text").cast("binary").alias("text")).dropDuplicates(["own"]), "shingle-texts")
    sizes = need.select("own").join(sets.select("own", "size"), "own")

    def verified(found: DataFrame) -> DataFrame:
        near = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        near = near.join(sizes.select(F.col("own").alias("a"), F.col("size").alias("p")), "a").join(sizes.select(F.col("own").alias("b"), F.col("size").alias("q")), "b")
        near = near.where(UNDER * F.least("p", "q") >= OVER * F.greatest("p", "q")).select("a", "b")
        both = near.join(known.select(F.col("own").alias("a"), F.col("text").alias("x")), "a").join(known.select(F.col("own").alias("b"), F.col("text").alias("y")), "b")
        return materialize(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "shingle-links")

    few, hot = members.where(F.col("m") <= pairs), members.where(F.col("m") > pairs)
    all_ = few.select("key", F.col("own").alias("a")).join(few.select("key", F.col("own").alias("b")), "key").where("a < b").select("a", "b")
    edges = verified(all_.union(hot.select(F.col("own").alias("a"), F.col("first").alias("b"))))
    if hot.limit(1).count():
        roots = materialize(components(edges), "shingle-roots")
        named = materialize(hot.select("key", "own").join(roots.withColumnRenamed("node", "own"), "own", "left").select("key", "own", F.coalesce("root", "own").alias("root")), "shingle-hot")
        most = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        named = materialize(named.join(sets.select("own", "size", "signs"), "own"), "shingle-signs")
        rest = named.join(most, "key").where("root <> main").select("key", F.col("own").alias("a"), F.col("root").alias("of_a"), F.col("size").alias("p"), F.col("signs").alias("x"))
        other = named.select("key", F.col("own").alias("b"), F.col("root").alias("of_b"), F.col("size").alias("q"), F.col("signs").alias("y"))
        differ = sum((F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(SIGNS)), F.lit(0))
        may = (UNDER * F.least("p", "q") >= OVER * F.greatest("p", "q")) & ((OVER + UNDER) * differ <= (UNDER - OVER) * (F.col("p") + F.col("q")))
        more = rest.join(other, "key").where("of_a <> of_b").where(may).select("a", "b")
        edges = edges.union(verified(more))
    return edges


def fingerprint_links(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows: text_hash, own; found (of near_duplicates): edges (a, b) that connect the sets of texts which found puts in one component."""
    roots = found.select("text_hash", "root").distinct().join(rows.select("text_hash", "own").distinct(), "text_hash").select("root", "own").distinct()
    roots = materialize(roots, "shingle-fingerprints")
    least = roots.groupBy("root").agg(F.min("own").alias("b"), F.count("*").alias("n")).where("n > 1")
    return join_unique(roots, materialize(least, "shingle-least"), "root", roots.count()).where("own <> b").select(F.col("own").alias("a"), "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS, fingerprints: bool = False) -> DataFrame:
    """doc_id, text_hash, root (the hash of a shingle set that names the component) and component_id (its least identifier)."""
    rows = materialize(sketches(docs, id_col, text_col), "shingle-sketches")
    sets = materialize(rows.groupBy("own").agg(F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.min("keys").alias("keys"), F.min("signs").alias("signs"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "shingle-sets")
    text = F.col(f"`{text_col}`").cast("string")
    edges = links(sets, docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")), pairs)
    if fingerprints:
        edges = edges.union(fingerprint_links(rows, near_duplicates(docs, id_col, text_col)))
    roots = components(edges)
    named = materialize(sets.select("own", "least", "n").join(roots.withColumnRenamed("node", "own"), "own", "left").withColumn("root", F.coalesce("root", "own")), "shingle-components")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("own", "n", "root", "component_id")
    return join_unique(rows.select("doc_id", "text_hash", "own"), materialize(named, "shingle-names"), "own", rows.count()).drop("own")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one document of each component: that with the smallest identifier."""
    return keep_one(docs, near_copies(docs, id_col, text_col, **options), id_col, text_col)
