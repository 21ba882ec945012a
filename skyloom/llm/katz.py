"""Katz backoff over words: a bigram model with Good-Turing discounts, counted and evaluated in one pass over the network.

Documents are cut into blocks of words. A block asks for what it needs, each different word and pair of words
once: its questions go, packed and sorted, to the part of the table that owns the history, which adds up the
counts of all blocks and answers each one. So the tables of counts are partitioned by history, never whole in
one place, and a token's probability is found in its block by backing off from pair to word to unknown word.
Histories with very many tokens are split over parts by the word that follows.

Words are told apart by 64-bit hashes, followers of one history by 48 bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import discard, fresh, stage

#: Tokens of a block, questions of a part of the table, and the count from which a history is split over parts.
BLOCK, PART = 600_000, 400_000
HOT = PART // 4
#: Counts up to this one are discounted.
K = 5
#: Keys that no word has, as words hold no blanks: what stands before a text, and its end.
START, END = (xxhash.xxh64_intdigest(x) for x in (b" start", b" end"))
LOW48 = np.uint64((1 << 48) - 1)

#: {0}: type of the texts' ids.
BLOCKS = "block long, uids array<long>, ids array<{0}>, train array<boolean>, opens array<boolean>, sizes array<long>, before array<long>, n_words long, n_pairs long, words binary, tokens binary"
ANSWERS = "block long, bucket long, payload binary, history long, sums array<double>, stats array<long>"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; bytes of one significance stand together."""
    codec, out = pa.Codec("zstd"), [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        small = codec.compress(raw, asbytes=True) if raw else b""
        out += [struct.pack("<3sQQ", a.dtype.str[1:].encode().ljust(3), len(a), len(small)), small]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, n, size = struct.unpack_from("<3sQQ", data, at)
        at += struct.calcsize("<3sQQ")
        dtype = np.dtype("<" + kind.decode().strip())
        raw = codec.decompress(data[at : at + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def cut(block_tokens: int, schema: str):
    """Rows (id, train, text) to blocks of words, numbered as they come: 0 stands before a text, 1 ends it."""
    arrow = _arrow(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, uid = TaskContext.get().partitionId() << 33, 0, -1

        def block() -> pa.RecordBatch:
            tokens, n = np.concatenate(own["tokens"]).astype(np.int32), len(number) + 2
            codes = np.concatenate([np.append(b, t[:-1]) for b, t in zip(own["before"], own["tokens"], strict=True)]) * n + tokens
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            row = {k: own[k] for k in ("uids", "ids", "train", "opens", "before")} | {"block": part + made, "sizes": [len(t) for t in own["tokens"]], "n_words": n, "n_pairs": len(np.unique(codes))}
            return _rows(arrow, [row | {"words": packed(np.append(np.array([START, END], np.uint64), words)), "tokens": packed(tokens)}])

        empty = lambda: ({}, {k: [] for k in ("uids", "ids", "train", "opens", "before", "tokens")}, 0)
        number, own, held = empty()
        for batch in batches:
            for k in range(batch.num_rows):
                key, train, text = (c[k].as_py() for c in batch.columns)
                uid += 1
                words, at, last = (text or "").encode().lower().split(), 0, None
                while at <= len(words):
                    some = words[at : at + block_tokens - held]
                    at += len(some)
                    ends = at == len(words) and held + len(some) < block_tokens
                    begin = 0 if last is None else number.setdefault(last, len(number)) + 2
                    coded = np.fromiter((number.setdefault(w, len(number)) + 2 for w in some), np.int64, len(some))
                    coded = np.append(coded, 1) if ends else coded
                    if len(coded):
                        for name, value in zip(own, (part + uid, key, bool(train), last is None, begin, coded), strict=True):
                            own[name].append(value)
                        held += len(coded)
                        last = some[-1] if some else last
                    if held >= block_tokens:
                        yield block()
                        made += 1
                        number, own, held = empty()
                    if ends:
                        break
        if held:
            yield block()

    return work


def _each(schema: str, make):
    """mapInArrow's function that makes rows of each row."""
    arrow = _arrow(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = make({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})
                if found:
                    yield _rows(arrow, found)

    return work


def _trained(row: dict) -> np.ndarray:
    return np.repeat(np.array(row["train"], bool), row["sizes"])


def _split(parts: np.ndarray) -> list[tuple[int, slice]]:
    """(part, its slice) of parts in order."""
    edges = np.flatnonzero(np.diff(parts, prepend=-1))
    return [(int(parts[a]), slice(a, b)) for a, b in zip(edges, np.append(edges[1:], len(parts)), strict=True)]


def _word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = _part_of(words, parts)
    order = np.lexsort((words, bucket))
    return order, bucket[order]


def ask_words(parts: int):
    """A block's questions about its words: the keys and how often they occur in its training texts."""

    def make(row: dict) -> list[dict]:
        words, tokens = unpacked(row["words"])[0], unpacked(row["tokens"])[0]
        count = np.bincount(tokens[_trained(row)], minlength=len(words))
        count[0] = sum(t and o for t, o in zip(row["train"], row["opens"], strict=True))
        order, bucket = _word_order(words, parts)
        return [{"block": row["block"], "bucket": b, "payload": packed(np.diff(words[order[own]], prepend=np.uint64(0)), count[order[own]])} for b, own in _split(bucket)]

    return _each("block long, bucket long, payload binary", make)


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return [int((count == r).sum()) for r in range(1, K + 2)]


def _answers(rows: list[tuple]) -> pd.DataFrame:
    """Whole numbers stay such beside nulls."""
    names = ("block", "bucket", "payload", "history", "sums", "stats")
    return pd.DataFrame({k: pd.array(x, dtype="Int64") if k in ("block", "bucket", "history") else pd.Series(x, dtype=object) for k, x in zip(names, map(list, zip(*rows, strict=True)), strict=True)})


def answer_words(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a part's words for each block that asked; stats: counts of counts, tokens, different words."""
    asked = [unpacked(p) for p in group["payload"]]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked])
    known, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in asked]), len(known)).astype(np.int64)
    own = total[known != np.uint64(START)]
    edges = np.cumsum([0, *[len(k) for k, _ in asked]])
    rows = [(b, p, packed(total[at[edges[i] : edges[i + 1]]]), None, None, None) for i, (b, p) in enumerate(zip(group["block"], group["bucket"], strict=True))]
    rows.append((None, None, None, None, None, [*_counts_of_counts(own), int(own.sum()), int((own > 0).sum())]))
    return _answers(rows)


class Discounts:
    """Good-Turing discounts of counts up to K; 1 where counts of counts give none."""

    def __init__(self, n: list[int]) -> None:
        """n: how many have count 1, 2, ... K + 1."""
        self.d = np.ones(K + 2)
        far = (K + 1) * n[K] / n[0] if n[0] else 1.0
        if far < 1:
            for r in range(1, K + 1):
                d = ((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) if n[r - 1] else 1.0
                self.d[r] = d if 0 < d < 1 else 1.0

    def of(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return count * self.d[np.minimum(count, K + 1)]

    def freed(self, n: np.ndarray) -> np.ndarray:
        """What is taken away in all, from how many there are of counts 1 to K, in columns."""
        return n @ (np.arange(1, K + 1) * (1 - self.d[1 : K + 1]))


class Words:
    """Probabilities of single words; what discounts free is that of an unknown word."""

    def __init__(self, n: list[int], tokens: int, kinds: int) -> None:
        self.discounts, self.tokens, self.kinds = Discounts(n), tokens, kinds
        freed = float(self.discounts.freed(np.array(n[:K], float)))
        self.all = tokens if freed > 0 else tokens + 1
        self.unknown = (freed or 1.0) / self.all

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.of(count) / self.all, self.unknown)


def pairs_of(row: dict, parts: int, hot: int) -> dict:
    """A block's different pairs of words, by part, history and word, with what it asks about them."""
    words, tokens, total = unpacked(row["words"])[0], unpacked(row["tokens"])[0].astype(np.int64), unpacked(row["totals"])[0]
    before = np.append(0, tokens[:-1])
    before[np.cumsum([0, *row["sizes"][:-1]])] = row["before"]
    code = before * len(words) + tokens
    marked = np.sort(code * 2 + _trained(row))
    starts = np.flatnonzero(np.diff(marked >> 1, prepend=-1))
    pair, count = marked[starts] >> 1, np.add.reduceat(marked & 1, starts)
    h, w = pair // len(words), pair % len(words)
    bucket = _part_of(np.where(total[h] > hot, words[h] ^ (words[w] * np.uint64(0xD6E8FEB86659FD93)), words[h]), parts)
    order = np.lexsort((words[w] & LOW48, words[h], bucket))
    return {"words": words, "total": total, "code": code, "pair": pair, "order": order, "h": h[order], "w": w[order], "count": count[order], "bucket": bucket[order]}


def _histories(h: np.ndarray) -> np.ndarray:
    """Where a new history begins."""
    return np.flatnonzero(np.diff(h, prepend=np.array([-1], h.dtype))) if len(h) else np.zeros(0, np.int64)


def ask_pairs(parts: int, hot: int):
    def make(row: dict) -> list[dict]:
        p, out = pairs_of(row, parts, hot), []
        for b, own in _split(p["bucket"]):
            h, w = p["h"][own], p["w"][own]
            at = _histories(h)
            low = np.ascontiguousarray((p["words"][w] & LOW48).view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
            split = (p["total"][h[at]] > hot).astype(np.uint8)
            out.append({"block": row["block"], "bucket": b, "payload": packed(np.diff(p["words"][h[at]], prepend=np.uint64(0)), np.diff(np.append(at, len(h))).astype(np.int32), split, low, p["count"][own], p["total"][w])})
        return out

    return _each("block long, bucket long, payload binary", make)


def answer_pairs(words: Words):
    """Totals of a part's pairs for each block that asked, and what backing off from each history needs: how many followers have
    counts 1 to K, and the followers' probability as single words. For split histories these are sums of one part, in rows of their own."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        asked, low, history, count, single, hot = [unpacked(p) for p in group["payload"]], [], [], [], [], []
        for keys, followers, split, codes, own, alone in asked:
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :6] = codes.reshape(-1, 6)
            low.append(wide.view(np.uint64).ravel())
            history.append(np.repeat(np.cumsum(keys, dtype=np.uint64), followers))
            hot.append(np.repeat(split, followers))
            count.append(own)
            single.append(alone)
        low, history, count, single, hot = (np.concatenate(x) for x in (low, history, count, single, hot))
        order = np.lexsort((low, history))
        low, sorted_history = low[order], history[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_history[1:] != sorted_history[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order], first)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        owner = sorted_history[first]
        begins = _histories_of(owner)
        n = np.stack([np.add.reduceat((total == r).astype(np.int64), begins) for r in range(1, K + 1)], 1)
        alone = np.add.reduceat(np.where(total > 0, words.of(single[order][first]), 0.0), begins)
        place = np.searchsorted(owner[begins], history)
        edges, rows = np.cumsum([0, *[len(x[4]) for x in asked]]), []
        for i, (b, p) in enumerate(zip(group["block"], group["bucket"], strict=True)):
            own = slice(edges[i], edges[i + 1])
            heads = place[own][np.cumsum(np.append(0, asked[i][1][:-1]))]
            rows.append((b, p, packed(total[at[own]], n[heads].ravel().astype(np.int64), alone[heads]), None, None, None))
        split = hot[order][first][begins] > 0
        rows += [(None, None, None, int(k.astype(np.int64)), [*map(float, c), float(s)], None) for k, c, s in zip(owner[begins][split], n[split], alone[split], strict=True)]
        rows.append((None, None, None, None, None, _counts_of_counts(total)))
        return _answers(rows)

    return work


def _histories_of(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


SCORES = "uid long, id {0}, trained boolean, n_tokens long, n_known long, base_score double, score double"


def evaluate(words: Words, pairs: Discounts, parts: int, hot: int, schema: str):
    """Scores of the pieces of texts in a block, from the answers to its questions."""

    def make(row: dict) -> list[dict]:
        p = pairs_of(row, parts, hot)
        got = [unpacked(x["payload"]) for x in sorted(row["answers"], key=lambda x: x["bucket"])]
        count, n, alone = (np.concatenate([x[i] for x in got]) for i in range(3))
        heads = np.flatnonzero((np.diff(p["h"], prepend=-1) != 0) | (np.diff(p["bucket"], prepend=-1) != 0))
        size = len(p["words"])
        n_of, alone_of = np.zeros((size, K)), np.zeros(size)
        n_of[p["h"][heads]], alone_of[p["h"][heads]] = n.reshape(-1, K), alone
        if row["hot"]:
            place = {int(k): i for i, k in enumerate(p["words"].astype(np.int64).tolist())}
            for x in row["hot"]:
                n_of[place[x["history"]]], alone_of[place[x["history"]]] = x["sums"][:K], x["sums"][K]
        freed, total = pairs.freed(n_of), p["total"]
        whole = np.where(freed > 0, total, total + 1)
        weight = np.where(total > 0, np.where(freed > 0, freed, 1.0) / whole / (1 - alone_of), 1.0)
        h, w = p["h"], p["w"]
        chance = np.where(count > 0, pairs.of(count) / whole[h], weight[h] * words.of(total[w]))
        by_pair = np.empty(len(chance))
        by_pair[p["order"]] = np.log10(chance)
        tokens = p["code"] % size
        at = np.cumsum([0, *row["sizes"][:-1]])
        sums = [np.add.reduceat(x, at) for x in (total[tokens] > 0, np.log10((total + 1) / (words.tokens + words.kinds + 1))[tokens], by_pair[np.searchsorted(p["pair"], p["code"])])]
        return [dict(zip(("uid", "id", "trained", "n_tokens", "n_known", "base_score", "score"), x, strict=True)) for x in zip(row["uids"], row["ids"], row["train"], row["sizes"], *[x.tolist() for x in (sums[0].astype(int), *sums[1:])], strict=True)]

    return _each(schema, make)


def _by_block(answers: DataFrame) -> DataFrame:
    return answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers"))


def _stats(answers: DataFrame, n: int) -> list[int]:
    return [int(x or 0) for x in answers.where("stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()]


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part: int = PART, hot: int = HOT) -> DataFrame:
    """Per row its id, trained (whether the model learned from it), n_tokens, n_known, train_tokens, base_score and score.

    score is log10 of the text's probability by the backoff model of the rows where train holds (null: not);
    base_score that by single words with one added to each count. A text is its words (by ASCII white space, A-Z
    made small) and an end; null texts are empty. An unknown word has the probability that the discounts of
    single words free. Repeated rows each count and each get a row; ids may be null; with no training rows every
    word is unknown and scores are 0; an empty table gives an empty one. Other columns are left out.

    block, part and hot bound a task's memory, not the result: tokens of a block, questions in a part, tokens
    from which a history is split over parts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    cut_schema, known_schema, score_schema = BLOCKS.format(kind), BLOCKS.replace("n_words long, n_pairs long", "totals binary, often array<long>").format(kind), SCORES.format(kind)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    blocks, path = stage(texts.mapInArrow(cut(block, cut_schema), cut_schema), "katz-blocks")
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    parts = [max(1, -(-int(x or 0) // part)) for x in sizes]
    asked = blocks.mapInArrow(ask_words(parts[0]), "block long, bucket long, payload binary")
    answers, answers_path = stage(asked.groupBy("bucket").applyInPandas(answer_words, ANSWERS), "katz-words")
    *n, tokens, kinds = _stats(answers, K + 3)
    words = Words(n, tokens, kinds)

    kept = [x for x in T._parse_datatype_string(known_schema).fieldNames() if x in blocks.columns]

    def with_totals(row: dict) -> list[dict]:
        keys = unpacked(row["words"])[0]
        order, _ = _word_order(keys, parts[0])
        total = np.zeros(len(keys), np.int64)
        total[order] = np.concatenate([unpacked(x["payload"])[0] for x in sorted(row["answers"], key=lambda x: x["bucket"])])
        return [{k: row[k] for k in kept} | {"totals": packed(total), "often": keys[total > hot].astype(np.int64).tolist()}]

    known, known_path = stage(blocks.join(_by_block(answers), "block").mapInArrow(_each(known_schema, with_totals), known_schema), "katz-known")
    discard(spark, path)
    discard(spark, answers_path)
    asked = known.drop("often").mapInArrow(ask_pairs(parts[1], hot), "block long, bucket long, payload binary")
    answers, answers_path = stage(asked.groupBy("bucket").applyInPandas(answer_pairs(words), ANSWERS), "katz-pairs")
    pairs = Discounts(_stats(answers, K + 1))
    split = answers.where("history is not null").groupBy("history").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(K + 1)]).alias("sums"))
    need = known.select("block", F.explode("often").alias("history")).join(split, "history").groupBy("block").agg(F.collect_list(F.struct("history", "sums")).alias("hot"))
    pieces, pieces_path = stage(known.drop("often").join(_by_block(answers), "block").join(need, "block", "left").mapInArrow(evaluate(words, pairs, parts[1], hot, score_schema), score_schema), "katz-scores")
    discard(spark, known_path)
    discard(spark, answers_path)
    sums = pieces.groupBy("uid").agg(F.any_value("id").alias("id"), F.any_value("trained").alias("trained"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    names = fresh([id_col], "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sums.withColumn("train_tokens", F.lit(words.tokens).cast("long")).select(F.col("id").alias(id_col), *[F.col(x.lstrip("_")).alias(x) for x in names])
