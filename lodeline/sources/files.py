"""Knowledge files: listing, digests, text, metadata of their chunks."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.keys import chunk_id
from lodeline.functions.splitter import chunk_documents
from lodeline.operators.search import GENERAL

SUFFIXES = (".txt", ".pdf")


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, source, length, content, file_hash) of the files below root, suffixes in any case. Spark skips names that begin with _ or a dot."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ends = "|".join(s.lstrip(".") for s in suffixes)
    return rows.filter(F.col("path").rlike(rf"(?i)\.(?:{ends})$")).select(
        "path", F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "").alias("source"), "length", "content", F.sha2("content", 256).alias("file_hash")
    )


def load_text(files: DataFrame) -> DataFrame:
    """Text files with `text`, strictly UTF-8 (a broken one fails the job by name), Windows line ends made plain."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string"))
    return files.filter(F.col("path").rlike(r"(?i)\.txt$")).withColumn("page", F.lit(0)).withColumn("text", text).drop("content")


def load_pdf(files: DataFrame) -> DataFrame:
    """One row for each page of the PDF files. Needs pypdf, which is optional."""
    if importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("reading PDF files needs pypdf")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for pdf in batches:
            for r in pdf.itertuples():
                texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(r.content)).pages]
                yield pd.DataFrame({"path": r.path, "source": r.source, "length": r.length, "file_hash": r.file_hash, "page": range(len(texts)), "text": texts})

    return files.filter(F.col("path").rlike(r"(?i)\.pdf$")).select("path", "source", "length", "content", "file_hash").mapInPandas(pages, "path string, source string, length long, file_hash string, page int, text string")


def subject_of(source: Column, subjects: list[str]) -> Column:
    """The first subject that begins the file's name, else the general one."""
    stem = F.regexp_extract(source, r"([^/]*?)(?:\.[^./]*)?$", 1)
    out = F.lit(GENERAL)
    for s in reversed(subjects):
        out = F.when(stem.startswith(s), s).otherwise(out)
    return out


def knowledge_chunks(texts: DataFrame, subjects: list[str], size: int = 500, overlap: int = 60) -> DataFrame:
    """Chunks of loaded files with source, file_hash, chunk_index (running on across pages), chunk_id, subject and text."""
    from pyspark.sql.window import Window as W

    cut = chunk_documents(texts, ["source", "file_hash", "page"], "text", size, overlap)
    index = F.row_number().over(W.partitionBy("source").orderBy("page", "chunk_index")) - 1
    rows = cut.withColumn("n", index)
    return rows.select("source", "file_hash", F.col("n").alias("chunk_index"), chunk_id(F.col("source"), F.col("file_hash"), F.col("n")).alias("chunk_id"), subject_of(F.col("source"), subjects).alias("subject"), F.col("chunk").alias("text"))
