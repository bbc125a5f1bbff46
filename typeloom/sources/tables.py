"""Readers of delimited files, workbooks, overrides and caches, and their writers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The separators and encodings that are tried, in order.
VARIANTS = [(";", "cp1252"), (";", "utf-8-sig"), (",", "utf-8-sig"), ("\t", "utf-8-sig")]
CHARSETS = {"cp1252": "windows-1252", "utf-8-sig": "UTF-8"}
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def stored(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """df written to the shared folder of the session and read again (by another session, if one
    is given), which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root.rstrip('/')}/typeloom/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def case_sensitive(df: DataFrame) -> DataFrame:
    """df, stored, in a session of its own in which n and N are two names, so that Spark writes
    both. The session of df, which others use too, stays as it is and reads the inputs. Who reads
    such a file with Spark needs spark.sql.caseSensitive as well."""
    spark, to_df = df.sparkSession, RDD.toDF
    own = spark.newSession()
    RDD.toDF = to_df  # PySpark gives it to the newest session
    for k, v in spark.conf.getAll.items():
        if own.conf.get(k, None) != v:
            own.conf.set(k, v)
    own.conf.set("spark.sql.caseSensitive", "true")
    return stored(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), own).toDF(*df.columns)


def first_bytes(spark: SparkSession, path: str, n: int = 65536) -> bytes:
    """The head of a file, through Hadoop's file systems, so that remote paths work too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(head: bytes) -> tuple[str, str]:
    """The first variant that gives more than one column; else the first that can be decoded.
    Text that ends in the middle of a character still counts."""
    fallback = None
    for sep, encoding in VARIANTS:
        try:
            line = head[: head.rfind(b"\n") + 1 or None].decode(encoding).splitlines()[0]
        except (UnicodeDecodeError, IndexError):
            continue
        fallback = fallback or (sep, encoding)
        if sep in line:
            return sep, encoding
    return fallback or VARIANTS[0]


def sniff_separator(line: str) -> str:
    return ";" if ";" in line else ","


def read_records(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A delimited file, every column a string, headings trimmed; separator and encoding are
    found from its head unless given. Nothing is inferred, so leading zeros stay."""
    if sep is None or encoding is None:
        found = sniff(first_bytes(spark, path))
        sep, encoding = sep or found[0], encoding or found[1]
    if CHARSETS.get(encoding, encoding) == "windows-1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, sep=sep, header=True, encoding=CHARSETS.get(encoding, encoding), inferSchema=False, multiLine=False)
    df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
    return df if columns is None else df.select(columns)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def _cells(book: bytes, sheet: str | int | None) -> tuple[list[str], list[list[str]]]:
    """Names of the sheets and the cells of one, as strings."""
    with zipfile.ZipFile(BytesIO(book)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        rels = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        book_ns = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        sheets = [(s.get("name"), rels[s.get(book_ns)]) for s in tree("xl/workbook.xml").iter(f"{SHEET}sheet")]
        names = [n for n, _ in sheets]
        at = sheet if isinstance(sheet, int) else names.index(sheet) if sheet in names else 0
        target = sheets[at][1]
        rows = []
        for row in tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{SHEET}row"):
            out: list[str] = []
            for c in row.iter(f"{SHEET}c"):
                place = 0
                for ch in "".join(x for x in c.get("r", "A") if x.isalpha()):
                    place = place * 26 + ord(ch) - 64
                value = c.find(f"{SHEET}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif value is None:
                    text = ""
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                out += [""] * (place - 1 - len(out)) + [text]
            rows.append(out)
        return names, rows


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = 0) -> DataFrame:
    """One sheet of each .xlsx file under a path, every column a string. Headings are taken from
    the first file; files are read in parallel, one a task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = _cells(files.first()["content"], sheet)[1][0]
    names = [h.strip() or f"column_{i}" for i, h in enumerate(head)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                body = _cells(content, sheet)[1][1:]
                yield pd.DataFrame([(r + [""] * len(names))[: len(names)] for r in body], columns=names, dtype=object)

    return files.mapInPandas(rows, schema)


def parse_overrides(text: str) -> dict[str, str]:
    """`key: value` lines of a flat YAML map; comments, quotes and blanks as YAML has them."""
    import yaml

    got = yaml.safe_load(text) or {}
    return {str(k).strip(): str(v).strip() for k, v in got.items() if str(k).strip() and v is not None}


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """pn, cluster from a YAML file of expert assignments; one that is missing gives no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    rows = parse_overrides(first_bytes(spark, path, 1 << 26).decode("utf-8")) if there else {}
    return spark.createDataFrame(list(rows.items()), "pn string, cluster string")


def overrides_yaml(df: DataFrame, header: str = "") -> str:
    """The text of an overrides file: a header, then keys in order. Experts' corrections are few."""
    rows = sorted((r.pn, r.cluster) for r in df.select("pn", "cluster").collect())
    return header + "".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in rows)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A ;-separated UTF-8 file with headings; one part only where a report is asked for."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def append_cache(df: DataFrame, path: str, key: str, value: str) -> None:
    """Append answers to a cache; failed ones (null) are not kept, so they are asked for again."""
    df.filter(F.col(value).isNotNull()).select(key, value).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table, or an empty one where none has been written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def result_document(parts: DataFrame, clusters: DataFrame, metrics: dict[str, float], stamp: str) -> DataFrame:
    """One JSON document a row: a head with the metrics, one for each cluster and each part, which
    a panel reads line by line; figures rounded to four places."""
    spark = parts.sparkSession
    rounded = {k: None if v is None else round(float(v), 4) for k, v in metrics.items()}
    head = spark.createDataFrame([("head", json.dumps({"generated": stamp, "metrics": rounded}))], "kind string, body string")
    body = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"))
    return head.unionByName(body(clusters, "cluster")).unionByName(body(parts, "part"))
