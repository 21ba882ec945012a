"""Search for composed pipelines: a generation is a DataFrame of genomes of variable length, the next one a query over it.

A genome is genome_id (0, 1, ... in a generation), ops (names with two parameters from 0 to 1, of which an operation
uses as many as it has), method and fitness. Chance is a mixing of whole numbers: (seed, generation, place, draw), so a
rerun has the same lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import pipelines
from skyloom.operators.pipelines import OPERATION_PARAMS, SCORE_METHODS
from skyloom.operators.spatial import kept
from skyloom.sources.survey import mixed

NAMES = list(OPERATION_PARAMS)
LEAST, MOST = 2, 5
#: Draws that a place has: tournaments, crossover, mutations and their parameters.
DRAWS = 64


def drawn(turn: Column, place: Column, k: int | Column) -> Column:
    return mixed((turn * 4096 + place) * DRAWS + (F.lit(k) if isinstance(k, int) else k))


def _pick(names: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(u * len(names)) + 1).cast("int"))


def _operation(turn: Column, place: Column, k: int) -> Column:
    return F.struct(_pick(NAMES, drawn(turn, place, k)).alias("name"), drawn(turn, place, k + 1).alias("a"), drawn(turn, place, k + 2).alias("b"))


def first_generation(spark: SparkSession, population: int, seed: int = 42) -> DataFrame:
    """genome_id, ops, method of random pipelines of two to five operations."""
    turn, place = F.lit(seed), F.col("genome_id")
    size = (LEAST + F.floor(drawn(turn, place, 0) * (MOST - LEAST + 1))).cast("int")
    ops = F.slice(F.array(*[_operation(turn, place, 1 + 3 * i) for i in range(MOST)]), F.lit(1), size)
    return spark.range(population).withColumnRenamed("id", "genome_id").select("genome_id", ops.alias("ops"), _pick(SCORE_METHODS, drawn(turn, place, 40)).alias("method"))


def next_generation(genomes: DataFrame, population: int, turn: int, rate: float = 0.2, elite: int = 2, tournament: int = 3) -> DataFrame:
    """The best genomes, and children of winners of tournaments: one-point crossover, then an operation changed, added or
    taken out, parameters moved and the method drawn anew, each by chance. Lengths stay from two to five.

    turn is a number of its own for each generation. Ties of fitness go to the smaller id.
    """
    t, place = F.lit(turn), F.col("place")
    best = genomes.orderBy(F.col("fitness").desc(), "genome_id").limit(elite)
    best = best.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("fitness")).alias("low"), "genome_id", "ops", "method"))).alias("all")).select(F.posexplode("all").alias("genome_id", "g"))
    kept_ones = best.select(F.col("genome_id").cast("long").alias("genome_id"), "g.ops", "g.method")
    places = genomes.sparkSession.range(elite, population).withColumnRenamed("id", "place")
    entries = places.withColumn("entry", F.explode(F.sequence(F.lit(0), F.lit(2 * tournament - 1)))).withColumn("genome_id", F.floor(drawn(t, place, F.col("entry")) * population))
    rank = F.struct("fitness", (-F.col("genome_id")).alias("low"))
    winners = entries.join(genomes, "genome_id").groupBy("place", (F.col("entry") < tournament).alias("first")).agg(F.max_by(F.struct("ops", "method"), rank).alias("g"))
    pairs = winners.groupBy("place").agg(F.max(F.when(F.col("first"), F.col("g"))).alias("a"), F.max(F.when(~F.col("first"), F.col("g"))).alias("b"))
    short = F.least(F.size("a.ops"), F.size("b.ops"))
    cut = F.when(short > 1, 1 + F.floor(drawn(t, place, 10) * (short - 1))).otherwise(F.size("a.ops")).cast("int")
    crossed = F.when(short > 1, F.concat(F.slice("a.ops", F.lit(1), cut), F.slice("b.ops", cut + 1, F.lit(MOST)))).otherwise(F.col("a.ops"))
    out = pairs.select("place", F.slice(crossed, 1, MOST).alias("ops"), F.col("a.method").alias("method"))
    n = F.size("ops")
    at = lambda k: F.floor(drawn(t, place, k) * n).cast("int")  # noqa: E731  from 0
    put = lambda i, skip, k: F.concat(F.slice("ops", F.lit(1), i), F.array(_operation(t, place, k)), F.slice("ops", i + 1 + skip, F.lit(MOST)))
    out = out.withColumn("ops", F.when(drawn(t, place, 11) < rate, put(at(12), 1, 13)).otherwise(F.col("ops")))
    out = out.withColumn("ops", F.when((drawn(t, place, 16) < rate * 0.5) & (n < MOST), put(F.floor(drawn(t, place, 17) * (n + 1)).cast("int"), 0, 18)).otherwise(F.col("ops")))
    out = out.withColumn("ops", F.when((drawn(t, place, 21) < rate * 0.3) & (n > LEAST), F.concat(F.slice("ops", F.lit(1), at(22)), F.slice("ops", at(22) + 2, F.lit(MOST)))).otherwise(F.col("ops")))
    move = lambda v, k, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + F.when(drawn(t, place, 24 + 6 * i) < rate, (drawn(t, place, k + 6 * i) + drawn(t, place, k + 1 + 6 * i) - 1) * 0.25).otherwise(0.0)))
    moved = F.transform("ops", lambda o, i: F.struct(o["name"].alias("name"), move(o["a"], 25, i).alias("a"), move(o["b"], 27, i).alias("b")))
    out = out.select("place", moved.alias("ops"), F.when(drawn(t, place, 60) < rate * 0.3, _pick(SCORE_METHODS, drawn(t, place, 61))).otherwise(F.col("method")).alias("method"))
    return kept_ones.unionByName(out.withColumnRenamed("place", "genome_id"))


def decoded(ops: list, method: str) -> tuple[list[tuple[str, dict]], str]:
    """The pipeline that a genome stands for: parameters from 0 to 1 as parts of their ranges or choices."""
    out = []
    for o in ops:
        params = {}
        for (name, kind), u in zip(OPERATION_PARAMS[o["name"]].items(), (o["a"], o["b"]), strict=False):
            if isinstance(kind, list):
                params[name] = kind[min(len(kind) - 1, int(u * len(kind)))]
            else:
                value = kind[0] + u * (kind[1] - kind[0])
                params[name] = round(value) if kind[2] == "int" else value
        out.append((o["name"], params))
    return out, method


def evolve(pixels: DataFrame, sources: DataFrame, width: int, height: int, population: int = 8, generations: int = 3, seed: int = 42, fitness=None) -> DataFrame:
    """(generation, genome_id, ops, method, fitness) of all generations.

    A generation's pipelines, a handful that the driver reads, are one plan over all images; fitness is their mean
    score, or what the given function of (generation's genomes) returns as (genome_id, fitness).
    """
    spark, history = pixels.sparkSession, None

    def scores(genomes: DataFrame) -> DataFrame:
        chosen = {str(g["genome_id"]): decoded(g["ops"], g["method"]) for g in genomes.collect()}
        found = pipelines.run(pixels, sources, chosen, width, height)
        return found.groupBy(F.col("pipeline").cast("long").alias("genome_id")).agg(F.avg("score").alias("fitness"))

    now = kept(first_generation(spark, population, seed))
    for generation in range(generations):
        own = kept(now.join((fitness or scores)(now), "genome_id").withColumn("generation", F.lit(generation)))
        history = own if history is None else history.unionByName(own)
        if generation + 1 < generations:
            now = kept(next_generation(own, population, seed + 1 + generation))
    return history.select("generation", "genome_id", "ops", "method", "fitness")
