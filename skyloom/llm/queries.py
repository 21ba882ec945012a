"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import ann, katz, langid, lines, mixing, packing, quality, runs, secret_scan, simhash, topk, turns, warc
from skyloom.llm.common import WORD, id_crc, load, new_path, word_count


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, the words that the mix takes, and its first and last training position (null where the mix leaves it out)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed = mixing.in_order(mixing.plan_mix(docs))
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"), F.round("last_position", 9).alias("last_position"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
k AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0) AS s_below, sum(weight) OVER (ORDER BY source_size / weight DESC, source DESC) AS w_above,
         (SELECT sum(source_size) FROM r) AS total
  FROM r WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - 3 * s_below)::DOUBLE / w_above AS level FROM k),
f AS (SELECT min_by(level, (source_size / weight, source)) AS level FROM l WHERE weight * level < 3 * source_size),
t AS (SELECT r.*, CASE WHEN weight * f.level >= 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * f.level END AS target FROM r, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (t.weight - 2) / 2 AS a,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + (CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END) ELSE 0 END AS copies FROM p),
y AS (SELECT *, CASE WHEN copies > 0 THEN middle / target END AS y0, CASE WHEN copies > 0 THEN ((copies - 1) * source_size + middle) / target END AS y1 FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       round(2 * y0 / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * y0)), 9) AS first_position,
       round(2 * y1 / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * y1)), 9) AS last_position
FROM y
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector its ten rows of highest integer inner product, by the bit-sliced index."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors, F.pmod("vec_id", F.lit(100)) == 0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document where it stands in the packed sequences; null texts are the end id alone."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_path())
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint and the least identifier of its component; null and blank texts have fingerprint zero."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts and the digest of base spans, and all spans; a null text is empty."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what its record says once the archive is written and read back; a null payload is empty."""
    pages, folder = load(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc")
    warc.write_warc(pages, folder)
    return warc.read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
n AS (
  SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS x,
         min(page_id) OVER (PARTITION BY hex) AS least
  FROM h),
b AS (
  SELECT *, list_transform(range(8), lambda g: (((x[5*g+1] * 16 + x[5*g+2]) * 16 + x[5*g+3]) * 16 + x[5*g+4]) * 16 + x[5*g+5]) AS v FROM n)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::BIGINT + 1, 1)), lambda l, r: l || r) AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM b
"""

def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the predicted language and its score; null texts and texts without letters are und."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its quality score and class; empty and null texts are scored too."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    model = quality.learn(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector its ten nearest rows found, by posting lists; null, zero and non-finite vectors take no part."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, F.pmod("vec_id", F.lit(100)) == 0)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many lines it has and which go, as they repeat or nearly repeat others; null texts have none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_report(docs, **lines.WHOLE)


def op11_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many tokens it has, how many of them training texts have, its base score and its score by the backoff model; a null text is empty, a null doc_id is trained on."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
    return katz.score_texts(docs, ~held).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation what damage did to it and the cheapest repair; nulls in rows are one blank, a conversation without rows has zeros, an empty audit and the hash of an empty string."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    damaged = rows.withColumn("h", h).where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(one("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text")).alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"),
    )
    report, repaired = turns.repair(damaged.drop("copy"))
    key = lambda df: df.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    out = key(rows.select("conv_id").distinct()).join(key(report).drop("conv_id"), "k", "left").join(key(turns.digests(repaired)).drop("conv_id"), "k", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the runs of its words, some of them made periodic as the contract says, and digests of the runs and of the text without repetitions.

    A null text has no words; a null doc_id has no check sum, so its text stays as it is.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    h = id_crc(F.col("doc_id"))
    n, g = word_count(F.col("text")), F.floor(h / 10)
    chosen = docs.withColumns({"n": F.when((h % 10 == 0) & (n > 0), n), "g": g}).withColumn("a", F.col("g") % F.col("n"))
    chosen = chosen.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).withColumn("words", F.when(F.col("n").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))))
    a, p, rest = (F.col(x).cast("int") for x in ("a", "p", "n"))
    unit = F.slice("words", a + 1, F.least(p, rest - a))
    periodic = F.concat(F.slice("words", F.lit(1), a), F.slice(F.flatten(F.array_repeat(unit, (F.ceil((rest - a) / p)).cast("int"))), F.lit(1), rest - a))
    texts = chosen.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.find_runs(texts)
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))))
    out = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_warc": op1_warc, "op2_simhash": op2_simhash, "op3_language": op3_language, "op4_quality": op4_quality, "op5_secrets": op5_secrets, "op6_neighbours": op6_neighbours, "op7_packing": op7_packing, "op8_lines": op8_lines, "op9_mixing": op9_mixing, "op10_topk": op10_topk, "op11_backoff": op11_backoff, "op12_repair": op12_repair, "op13_runs": op13_runs}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op9_mixing": OP9_SQL, "op10_topk": OP10_SQL}
