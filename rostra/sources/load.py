"""Loading the fact table, and sinks."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.functions.numeric import lookup, nan_to_null
from rostra.schema import COUNTRY_NAMES, DISCOURSES, EXPORT, INVALID, M7, SCORES, WEB_DATA


def resolve(root: str | os.PathLike, configured: str = "", slim: str = "web", full: str = "full") -> str:
    """Folder of the tables: the slim one if it is there and none is configured, else the configured one (a relative
    path is below root's parent), else the full one beside root."""
    here = Path(root)
    if configured:
        return configured if "://" in configured or Path(configured).is_absolute() else str((here.parent / configured).resolve())
    return str(here / slim) if (here / slim).exists() else str(here.parent / full)


def register(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Parquet tables of a folder as temporary views."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def tables(spark: SparkSession) -> set[str]:
    return {t.name for t in spark.catalog.listTables()}


def validated(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """The schema's columns in its types, and any others; fails if one is missing."""
    missing = sorted(set(schema.names) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def join_scores(scores: DataFrame, discourses: DataFrame) -> DataFrame:
    """Scored documents of a valid type; a null type is dropped as well."""
    s, d = validated(scores, SCORES, "scores").alias("s"), validated(discourses, DISCOURSES, "discourses").alias("d")
    joined = s.join(d, F.col("d.id") == F.col("s.discourse_id")).where(F.col("s.final_score").isNotNull() & (F.col("d.dtype") != INVALID))
    return joined.select(*[F.col(f"s.{m}") for m in [*M7, "n_chunks"]], "d.iso3", "d.leader_name", F.col("d.discourse_year").alias("year"), "d.dtype", "d.word_count")


def labelled(df: DataFrame, names: dict[str, str] = COUNTRY_NAMES) -> DataFrame:
    """NaN as null, the country's label, and the leader's short name."""
    df = df.withColumns({m: nan_to_null(m) for m in M7})
    return df.withColumns({"country": lookup(F.col("iso3"), names), "leader_short": F.col("leader_name")})


def load_scored(spark: SparkSession, cached: bool = True) -> DataFrame:
    """The fact from the catalog: web_data if there is such a table, else scores joined with discourses."""
    if spark.catalog.tableExists("web_data"):
        fact = validated(spark.table("web_data"), WEB_DATA, "web_data")
    else:
        fact = join_scores(spark.table("scores"), spark.table("discourses"))
    fact = labelled(fact)
    return fact.cache() if cached else fact


def records(df: DataFrame) -> list[dict]:
    """A small result as a list of dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, in the column json."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def exported(df: DataFrame) -> DataFrame:
    """Per-document scores without text, in the published order of columns; those that df lacks are null."""
    names = {"discourse_type": "dtype"}
    columns: list[Column] = []
    for c in EXPORT:
        source = c if c in df.columns else names.get(c, c)
        columns.append(F.col(source).alias(c) if source in df.columns else F.lit(None).cast("string").alias(c))
    return df.select(*columns)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """exported() as csv, as xlsx (one file, on the driver's disk), or in another format of Spark's."""
    rows = exported(df)
    if kind == "xlsx":
        write_xlsx(rows, path)
        return
    out = rows.write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.format(kind).save(path)


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="scores" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Rows that a sheet can hold.
SHEET_ROWS = 1 << 20


def _cell(value: object) -> str:
    if value is None or isinstance(value, float) and value != value:
        return "<c/>"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f"<c><v>{value!r}</v></c>"
    text = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str) -> None:
    """A spreadsheet of one sheet with a header; rows come to the driver a partition at a time.  Raises ValueError beyond SHEET_ROWS."""
    if df.limit(SHEET_ROWS).count() == SHEET_ROWS:
        raise ValueError("a sheet can't hold so many rows")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, body in _PARTS.items():
            out.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
        with out.open("xl/worksheets/sheet1.xml", "w") as sheet:
            put = lambda row: sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            put(df.columns)
            for row in df.toLocalIterator():
                put(row)
            sheet.write(b"</sheetData></worksheet>")
