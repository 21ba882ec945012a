"""Packing documents into token sequences, shortest pack first over the histogram of lengths.

Texts become token ids with an end id; a document over the capacity is cut into full pieces and a
rest. Only the histogram of piece lengths, at most as many rows as the capacity, comes to the driver.
There lengths are placed longest first, each copy into the open pack with the most room, whole groups
of like packs at a time; the outcome is a table of patterns with counts, bounded by the capacity and not
by the corpus. A piece finds its place by its rank among the pieces of its length; ranks come from
counts by (length, hash bucket), so a length that a third of all pieces share is spread.

Defined results: a null or empty text is the end id alone; equal rows get places of their own; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import materialize

#: Hash buckets of a length.
BUCKETS = 256
#: A worker forgets the words it knows beyond so many.
KNOWN_WORDS = 600_000
PLACES = "length int, first long, last long, copies int, base long, at int"


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, by the ids of their blank-separated parts.

    For tokenizers whose tokens never hold white space, as those that drop it: the ids of a text are
    then those of its parts, and most parts recur.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, parts = self.known, [x.replace("\n", " ").split(" ") for x in texts]
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = set().union(*parts)
        cores = {p: q for p in new if (q := p.rstrip(string.punctuation)) != p and q.isalpha()}  # letters and the marks after them are split anyway
        self.learn(list(new.difference(cores).union({q for p, core in cores.items() for q in (core, p[len(core) :])}.difference(known))))
        known.update({p: known[core] + known[p[len(core) :]] for p, core in cores.items()})
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def learn(self, words: list[str]) -> None:
        """Words of letters alone go together, as one text whose ids tell where each word ends; others one by one."""
        plain = [p for p in words if p.isalpha()]
        alone = [p for p in words if not p.isalpha()]
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):  # a letter that the tokenizer takes for something else
                alone += some
                continue
            data = ids.tobytes()
            self.known.update(zip(some, [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        for at in range(0, len(alone), 2048):
            some = alone[at : at + 2048]
            for p, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(got.ids, "<u4").tobytes()


#: A Python worker's encoders by path; they outlive its tasks, as most words recur.
_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, start, length, ids_crc32, doc_tokens and ids (bytes) if wanted."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                own, out = [], []
                for k, ids in enumerate(encode([x or "" for x in batch.column(1).to_pylist()])):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        own.append(k)
                        out.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4) + ((piece,) if with_ids else ()))
                made = [batch.column(0).take(pa.array(own, pa.int32()))]
                made += [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=False)]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(cut, schema)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (number of sequences, ((length, copies), ...)) that hold exactly the counted lengths."""
    done: list[tuple[int, tuple]] = []
    open_: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # by room left
    most = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            while most > 0 and not open_[most]:
                most -= 1
            if most < length:  # no open pack has room: new ones, filled as the rule would fill them
                per = capacity // length
                for n, copies in ((left // per, per), (1, left % per)):
                    if n and copies:
                        room = capacity - copies * length
                        (open_[room] if room else done).append((n, ((length, copies),)))
                        most = max(most, room)
                break
            n, runs = open_[most].pop()
            if n > left:
                open_[most].append((n - left, runs))
                n = left
            runs = (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))
            (open_[most - length] if most > length else done).append((n, runs))
            left -= n
    return sorted(done + [x for own in open_ for x in own], key=lambda x: x[1], reverse=True)


def places(patterns: list[tuple[int, tuple]]) -> list[tuple]:
    """For each run of a pattern, the ranks that it holds and where they go: rows of PLACES."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for n, runs in patterns:
        at = 0
        for length, copies in runs:
            first = taken.get(length, 0)
            taken[length] = first + n * copies
            out.append((length, first, first + n * copies, copies, base, at))
            at += length * copies
        base += n
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = 4096) -> DataFrame:
    """pieces (with an int column length) with sequence_id and offset; order names the columns that tell pieces apart."""
    spark: SparkSession = pieces.sparkSession
    counted = pieces.groupBy("length", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = F.broadcast(spark.createDataFrame(places(pack_histogram(counts, capacity)), PLACES)).withColumnRenamed("length", "of")
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    ranked = (
        pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("below"))
    )
    placed = ranked.join(where, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    turn = F.col("rank") - F.col("first")
    sequence = F.col("base") + F.floor(turn / F.col("copies"))
    offset = F.col("at") + F.pmod(turn, F.col("copies")) * F.col("length")
    return placed.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, **columns) -> DataFrame:
    """docs cut, packed and given back as pieces; with_ids carries the ids themselves."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids, **columns), "pack-pieces")
    return pack(pieces, ["doc_id", "start", "ids_crc32"], capacity)
