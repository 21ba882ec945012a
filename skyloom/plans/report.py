"""Run folders and reports: tables by Spark, and the page that shows their small summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import evaluation

#: The least significance rating (1 to 10) of each word, and the word below all.
LABELS, LEAST_LABEL = ((8, "High"), (5, "Moderate"), (3, "Low")), "Very Low"
#: Classes as readers see them.
DISPLAY = {
    "gravitational_lens": "Gravitational lens candidate",
    "morphological_anomaly": "Morphological anomaly",
    "galaxy_interaction": "Galaxy interaction",
    "kinematic_group": "Kinematic group",
    "galaxy_structure": "Galaxy structure anomaly",
    "multiscale_source": "Multi-scale source",
    "stellar_population_anomaly": "Stellar population anomaly",
    "spatial_clustering": "Spatial clustering",
    "transient_candidate": "Transient candidate",
    "statistical_outlier": "Statistical outlier",
    "classical_pattern": "Classical pattern",
    "variable_star": "Variable star candidate",
    "temporal_change": "Temporal change",
}


def confidence_label(rating):
    out = F.lit(LEAST_LABEL)
    for cut, name in reversed(LABELS):
        out = F.when(rating >= cut, name).otherwise(out)
    return out


def display_name(classification):
    return F.coalesce(F.try_element_at(evaluation.literal_map(DISPLAY), classification), F.initcap(F.replace(classification, F.lit("_"), F.lit(" "))))


def described(findings: DataFrame) -> DataFrame:
    """A sentence for each finding."""
    return findings.withColumn("description", F.format_string("%s by the %s detector in region %s, score %.2f (%s)", "anomaly_type", "detector", F.col("region_id").cast("string"), "score", confidence_label(F.round(F.col("score") * 10))))


class Run:
    """A folder of a run: state, results and reports, in Parquet and JSON by Spark's writers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(path := f"{self.folder}/{name}")
        return path

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def json(self, name: str, df: DataFrame) -> str:
        df.write.mode("overwrite").json(path := f"{self.folder}/{name}")
        return path

    def text(self, name: str, body: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(body.encode()))
        out.close()
        return f"{self.folder}/{name}"


def latest(spark: SparkSession, folder: str) -> str | None:
    """The last run in a folder by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
    return names[-1] if names else None


def markdown(findings: DataFrame, title: str = "Survey report", most: int = 20) -> str:
    """The report page: findings in their categories (the first most of each), and tables by type and detector."""
    lines = [f"# {title}", ""]
    for name in ("NEW", "KNOWN", "LOW"):
        own = described(findings.where(F.col("category") == name))
        n = own.count()
        lines += [f"## {name} ({n})", "", *[f"{k}. {r['description']}" for k, r in enumerate(own.orderBy(F.col("score").desc(), "seq").limit(most).collect(), 1)], ""]
    for head, df in (("Types", evaluation.by_type(findings).orderBy(F.col("n").desc(), "anomaly_type")), ("Detectors", evaluation.by_detector(findings).orderBy("detector"))):
        rows = df.limit(100).collect()
        lines += [f"## {head}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(lines)
