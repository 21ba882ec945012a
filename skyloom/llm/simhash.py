"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into six blocks. Two fingerprints that differ in at most three bits
agree on at least three whole blocks, so every close pair shares one of the twenty keys made of three
blocks (about 32 bits). Only distinct fingerprints meet. The members of a key are verified in bulk by
XOR and bit counts and leave a spanning forest, never all pairs. A key with more than KEY_MEMBERS
members is cut again: of eight parts of the other bits any close pair shares five, and such a key leaves
at most twelve bits open, hence 4,096 distinct members, whatever the data are.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; rows
with a null identifier belong to components but never name them, so a component of null identifiers
only has the id null; repeated rows are in one component; an empty table gives no rows; other columns
are not read (near_duplicates) or carried unchanged whatever their names (drop_near_duplicates).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import fresh, join_unique, materialize
from skyloom.llm.graph import components

SEED = 42
DISTANCE = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
KEY_MEMBERS = 4096
#: Digests whose bits are counted at a time.
SLICE = 8192


def shingle_digests(text: bytes, words: int) -> list[bytes]:
    """The big-endian XXH64 of each shingle of a text in UTF-8."""
    found = text.lower().split()  # ASCII letters and ASCII white space, as these are bytes
    if len(found) <= words:
        return [xxhash.xxh64_digest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majority(digests: list[bytes]) -> int:
    """The bits set in over half of the digests, as a signed long; a slice of them at a time, however many there are."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(digests), SLICE):
        some = np.frombuffer(b"".join(digests[low : low + SLICE]), np.uint8)
        counts += np.unpackbits(some.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(digests)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and text_hash, which tells texts of one identifier apart."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_digests(x.as_py() or b"", words)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=schema.names)

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`"), F.xxhash64(text), text.cast("binary")).mapInArrow(run, schema)


def _masks(parts: list[int], shared: int) -> list[int]:
    """For each choice of as many of the parts (bit masks), the mask of their union as a signed long."""
    return [x - (1 << 64) if x >> 63 else x for x in (sum(own) for own in combinations(parts, shared))]


def _blocks() -> list[int]:
    out, low = [], 0
    for n in BLOCKS:
        out.append(((1 << n) - 1) << low)
        low += n
    return out


def _finer(mask: int) -> list[int]:
    """The masks that add five of eight parts of the bits that mask leaves open."""
    open_ = [1 << i for i in range(64) if not mask >> i & 1]
    parts = [sum(open_[i] for i in own) for own in np.array_split(np.arange(len(open_)), 8)]
    own = mask & ((1 << 64) - 1)
    return [x - (1 << 64) if x >> 63 else x for x in (own | sum(more) for more in combinations(parts, 8 - DISTANCE))]


def _links(members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance."""
    if len(members) == 2:
        a, b = members.tolist()
        return [(a, b)] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= DISTANCE else []
    out, rest = [], members.view(np.uint64)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= DISTANCE
            if near.any():
                found = rest[near]
                front += list(found)
                out += [(int(at.view(np.int64)), x) for x in found.view(np.int64).tolist()]
                rest = rest[~near]
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        out = [x for a, b in zip(offsets[:-1], offsets[1:], strict=True) for x in _links(values[a:b])]
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(fps: DataFrame, key_members: int = KEY_MEMBERS) -> DataFrame:
    """fps: distinct fingerprints (fp). Edges (a, b) that connect whatever pairs within the distance connect."""
    spark = fps.sparkSession
    masks = _masks(_blocks(), len(BLOCKS) - DISTANCE)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    counts = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(counts, ["choice", "part"]), "simhash-keys")
    gather = lambda df, *by: df.groupBy(*by).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    cold = gather(members.where(F.col("n") <= key_members), "choice", "part")
    finer = spark.createDataFrame([(i, j, x) for i, m in enumerate(masks) for j, x in enumerate(_finer(m))], "choice int, finer int, mask long")
    hot = members.where(F.col("n") > key_members).join(F.broadcast(finer), "choice")
    hot = gather(hot.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "choice", "finer", "part")
    return cold.union(hot).mapInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, key_members: int = KEY_MEMBERS) -> DataFrame:
    """doc_id, text_hash, fingerprint (hexadecimal), root (a fingerprint that names the component) and component_id."""
    own = materialize(fingerprints(docs, id_col, text_col, words), "simhash-fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(links(fps.select("fp"), key_members)).withColumnRenamed("node", "fp")
    named = materialize(roots.join(fps.drop("n"), "fp"), "simhash-components")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "root").select("fp", "root", "component_id")
    all_ = fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = join_unique(own, materialize(all_, "simhash-names"), "fp", own.count())
    return out.select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one document of each component: that with the smallest identifier."""
    return keep_one(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without all but one document of each root of found (doc_id, text_hash, root, component_id)."""
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("x"))
    known, hash_, rank, known_k, hash_k = fresh(docs.columns, "known", "hash", "rank", "known_kept", "hash_kept")
    kept = kept.select(F.coalesce(F.col("x.doc_id").cast("string"), F.lit("")).alias(known_k), F.col("x.text_hash").alias(hash_k))
    keyed = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias(known), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(hash_))
    joined = keyed.join(kept, (F.col(known) == F.col(known_k)) & (F.col(hash_) == F.col(hash_k)), "left_semi")
    first = joined.withColumn(rank, F.row_number().over(Window.partitionBy(known, hash_).orderBy(F.lit(0))))
    return first.where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
