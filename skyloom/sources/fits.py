"""FITS images: a reader over binaryFile and a writer, for the first header unit with an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SCHEMA = "image_id string, height int, width int, data array<float>, header map<string,string>"


def parse(content: bytes) -> tuple[np.ndarray, dict[str, str]] | None:
    """The first image of two dimensions or more (its first plane), as float32, with its header."""
    at = 0
    while at < len(content):
        header: dict[str, str] = {}
        ended = False
        while not ended and at < len(content):
            for k in range(0, BLOCK, CARD):
                card = content[at + k : at + k + CARD].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    value = card[10:]
                    header[key] = value.split("'")[1].rstrip() if value.lstrip().startswith("'") else value.split("/")[0].strip()
            at += BLOCK
        shape = [int(header[f"NAXIS{k}"]) for k in range(int(header.get("NAXIS", 0)), 0, -1)]
        bits = int(header.get("BITPIX", 8))
        size = abs(bits) // 8 * int(np.prod(shape)) if shape else 0
        if len(shape) >= 2 and size:
            data = np.frombuffer(content, KINDS[bits], int(np.prod(shape)), at).reshape(shape)
            while data.ndim > 2:
                data = data[0]
            return (data * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))).astype(np.float32), header
        at += -(-size // BLOCK) * BLOCK
    return None


def serialise(data: np.ndarray, header: dict[str, str] | None = None) -> bytes:
    cards = [("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "2"), ("NAXIS1", str(data.shape[1])), ("NAXIS2", str(data.shape[0]))]
    skip = {k for k, _ in cards} | {"BSCALE", "BZERO", "EXTEND"}
    text = "".join(f"{k:<8}= {v:>20}".ljust(CARD) for k, v in cards)
    for k, v in (header or {}).items():
        if k not in skip and not k.startswith("NAXIS"):
            plain = v.replace(".", "", 1).replace("-", "", 1).replace("E", "", 1).isdigit() or v in ("T", "F")
            text += f"{k:<8}= {v:>20}".ljust(CARD) if plain else f"{k:<8}= '{v}'".ljust(CARD)
    text = (text + "END".ljust(CARD)).ljust(-(-(len(text) + CARD) // BLOCK) * BLOCK)
    body = data.astype(">f4").tobytes()
    return text.encode("ascii") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row an image; files without an image give none. Files are read whole, each in its own task slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, found) for p, c in zip(batch["path"], batch["content"], strict=True) if (found := parse(c))]
            yield pd.DataFrame([(p, d.shape[0], d.shape[1], d.ravel(), h) for p, (d, h) in rows], columns=["image_id", "height", "width", "data", "header"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Images with the name of their folder as label, for training."""
    return read(spark, path).withColumn("label", F.element_at(F.split("image_id", "/"), -2))


def augment(data: np.ndarray, turn: int, flip: bool, noise: float, seed: int) -> np.ndarray:
    """Quarter turns, a mirror image and Gaussian noise in units of the image's deviation."""
    out = np.rot90(data, turn)
    out = out[:, ::-1] if flip else out
    return out + np.random.default_rng(seed).normal(0, noise * (data.std() or 1.0), out.shape) if noise else out
