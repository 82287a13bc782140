"""Raw files as rows: decoding, routing by suffix, guards. A bad file is a row with an error, not a failed job."""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_id_of, normalize, render_rows, stem
from . import office

PLAIN = (".txt", ".md", ".markdown", ".log")
TABLES = (".csv", ".tsv")
MAX_BYTES, MAX_CHARS = 20 * 1024 * 1024, 2_000_000


#: What a parser gives: texts as they are, and tables as rows of cells, in their order.
Parts = list[tuple[str, str | list[list[str]]]]


def _pdf(raw: bytes) -> Parts:
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        reader.decrypt("")
    return [("", t) for page in reader.pages if (t := (page.extract_text() or "").strip())]


@dataclass(frozen=True)
class Parser:
    """``parse`` takes a file's bytes; ``joint`` stands between its parts. A part is left out where it is blank, its heading too."""

    parse: Callable[[bytes], Parts]
    joint: str


#: Parsers by suffix; give :func:`extract` a table of your own to add formats.
PARSERS = {".pdf": Parser(_pdf, "\n\n"), ".docx": Parser(office.docx, "\n"), ".xlsx": Parser(office.xlsx, "\n\n"), ".xlsm": Parser(office.xlsx, "\n\n")}


def formats(spark: SparkSession, parsers: dict[str, Parser] | None = None) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted({*PLAIN, *TABLES, *(PARSERS if parsers is None else parsers)})], "extension string")


def files(spark: SparkSession, path: str, pattern: str = "*.*") -> DataFrame:
    """path, content of the files below ``path`` whose names don't begin with a dot."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.where(~F.col("path").rlike(r"/\.[^/]*$")).select("path", "content", "length")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _decoded(raw: bytes) -> tuple[str, str]:
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    name = next((n for m, n in marks if raw.startswith(m)), None)
    for trial in [name] if name else ["utf-8", "gb18030"]:
        try:
            return raw.decode(trial), trial
        except UnicodeDecodeError:
            continue
    return raw.decode(name or "gb18030", "replace"), name or "gb18030"


def decode(content: Column) -> Column:
    """text, encoding: by byte order mark; else UTF-8 if valid; else GB18030, with replacements where it isn't valid."""

    @F.pandas_udf("text string, encoding string")
    def apply(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decoded(bytes(raw or b"")) for raw in contents], columns=["text", "encoding"])

    return apply(content)


def csv_rows(text: Column, kind: Column) -> Column:
    """Cells of each line of CSV and TSV texts, quotes respected; null for other kinds. Put it in a column before it is rendered."""

    @F.pandas_udf("array<array<string>>")
    def parse(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        import csv

        marks = {".csv": ",", ".tsv": "\t"}
        return pd.Series([[[c.strip() for c in r] for r in csv.reader(io.StringIO(t or ""), delimiter=marks[k])] if k in marks else None for t, k in zip(texts, kinds, strict=True)], dtype=object)

    return parse(text, kind)


_PARTS = "parts array<struct<heading:string,text:string,cells:array<array<string>>>>, failure string"


def parsed(kind: Column, content: Column, parsers: dict[str, Parser]) -> Column:
    """parts, failure of files that a parser takes: a parser that is missing, or fails, is named in ``failure``."""

    def one(suffix: str, raw: bytes | None) -> tuple:
        if suffix not in parsers or raw is None:
            return None, None
        try:
            found = parsers[suffix].parse(bytes(raw))
        except Exception as e:  # whatever a parser raises is this file's error
            return None, f"{type(e).__name__}: {e}"
        return [{"heading": h, "text": x if isinstance(x, str) else None, "cells": None if isinstance(x, str) else x} for h, x in found], None

    @F.pandas_udf(_PARTS)
    def apply(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(k, c) for k, c in zip(kinds, contents, strict=True)], columns=["parts", "failure"])

    return apply(kind, content)


def joined_parts(kind: Column, parts: Column, parsers: dict[str, Parser]) -> Column:
    """The text of a file's parts, tables rendered."""
    body = lambda p: F.coalesce(p["text"], render_rows(p["cells"]))
    full = F.filter(F.transform(parts, lambda p: F.struct(p["heading"].alias("heading"), body(p).alias("body"))), lambda p: F.btrim(p["body"]) != "")
    whole = F.transform(full, lambda p: F.concat(F.coalesce(p["heading"], F.lit("")), p["body"]))
    joint = F.lit("\n")
    for suffix, parser in parsers.items():
        joint = F.when(kind == suffix, parser.joint).otherwise(joint)
    return F.aggregate(whole, F.lit(None).cast("string"), lambda all_, x: F.when(all_.isNull(), x).otherwise(F.concat(all_, joint, x)))


def extract(raw: DataFrame, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, extension, encoding, text, chars_raw, chars, truncated, error for (path, content)."""
    parsers = PARSERS if parsers is None else parsers
    rows = raw.withColumn("extension", extension(F.col("path"))).withColumn("bytes", F.octet_length("content"))
    guard = (
        F.when(~F.col("extension").isin(*PLAIN, *TABLES, *parsers), F.concat(F.lit("unsupported format: "), "extension"))
        .when(F.coalesce("bytes", F.lit(0)) == 0, "empty file")
        .when(F.col("bytes") > max_bytes, "file too large")
    )
    good = F.when(F.col("error").isNull(), F.col("content"))
    is_parsed = F.col("extension").isin(*parsers)
    decoded = rows.withColumn("error", guard).withColumn("d", decode(F.when(~is_parsed, good))).withColumn("p", parsed(F.col("extension"), F.when(is_parsed, good), parsers))
    decoded = decoded.withColumn("cells", csv_rows(F.col("d.text"), F.col("extension")))
    text = F.when(F.col("extension").isin(*TABLES), render_rows(F.col("cells"))).when(is_parsed, joined_parts(F.col("extension"), F.col("p.parts"), parsers)).otherwise(F.col("d.text"))
    clean = decoded.withColumn("whole", F.when(F.col("error").isNull(), normalize(text)))
    error = F.coalesce("error", "p.failure", F.when(F.coalesce("whole", F.lit("")) == "", "no text"))
    good = F.when(error.isNull(), F.col("whole"))
    return clean.select(
        "path", "extension", F.when(error.isNull() & ~is_parsed, F.col("d.encoding")).alias("encoding"),
        F.substring(good, 1, max_chars).alias("text"), F.char_length(good).alias("chars_raw"),
        F.char_length(F.substring(good, 1, max_chars)).alias("chars"), (F.char_length(good) > max_chars).alias("truncated"), error.alias("error"),
    )


def uploads(extracted: DataFrame) -> DataFrame:
    """doc_id, title, text, truncated, error of extracted files: what an upload is stored as. The title is the name without its suffix."""
    title = stem(F.col("path"))
    return extracted.select(doc_id_of(F.col("path")).alias("doc_id"), F.when(title == "", F.col("path")).otherwise(title).alias("title"), "text", "truncated", "error")
