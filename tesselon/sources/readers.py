"""Readers: directories of files, delimited text, office documents, JSON logs.

Spark lists and reads; a parser sees one file's bytes at a time, Arrow batches at a time, on the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.operators.scope import language_of, skip_reason

OFFICE = ("docx", "xlsx", "csv", "pptx", "ppt")


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-01, SRC-02: (path, size, content, language, skip_reason) of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split("://")[-1].lstrip("/").removeprefix("file:")
    rel = F.regexp_replace("path", rf"^.*?{re.escape(root)}/", "")
    return raw.select(rel.alias("path"), F.col("length").alias("size"), "content").withColumns(
        {"language": language_of(F.col("path")), "skip_reason": skip_reason(F.col("path"), F.col("size"))}
    )


def looks_like_pdf(path: Column, content: Column) -> Column:
    """SRC-20: the extension and the first bytes agree."""
    return F.lower(path).endswith(".pdf") & (F.substring(content, 1, 4) == F.lit(bytearray(b"%PDF")))


# --- delimited text (SRC-10, SRC-11) -------------------------------------------------------------------------
_CELL = re.compile(r'((?:[^,"]|"(?:[^"]|"")*(?:"|$))*)(,|$)')


def split_cells(line: str) -> list[str]:
    """Cells of one line: commas inside quotes do not part, a doubled quote is one, cells are trimmed."""
    cells, at = [], 0
    while True:
        m = _CELL.match(line, at)
        body = re.sub(r'"((?:[^"]|"")*)(?:"|$)', lambda q: q[1].replace('""', '"'), m[1])
        cells.append(body.strip())
        if not m[2]:
            return cells
        at = m.end()


def rows_to_text(rows: list[list[str]]) -> str:
    lines = [" | ".join(r) for r in rows]
    return "\n".join(x for x in lines if x.strip())


def csv_text(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    return rows_to_text([split_cells(x) for x in re.split(r"\r?\n", text) if x.strip()])


# --- office documents (SRC-12..18) ----------------------------------------------------------------------------
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _number(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


def _texts(node: ElementTree.Element) -> list[str]:
    return [x.text or "" for x in node.iter() if _local(x.tag) == "t"]


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(_texts(p)) for p in root.iter() if _local(p.tag) == "p")


def xlsx_text(data: bytes) -> str:
    """Sheets under their names; shared and inline strings, booleans, numbers as written; empty rows and sheets left out."""
    if data[:2] != b"PK":
        return csv_text(data)
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist()}
        shared = []
        if "xl/sharedstrings.xml" in names:
            root = ElementTree.fromstring(z.read(names["xl/sharedstrings.xml"]))
            shared = ["".join(_texts(si)) for si in root if _local(si.tag) == "si"]
        titles = []
        if "xl/workbook.xml" in names:
            root = ElementTree.fromstring(z.read(names["xl/workbook.xml"]))
            titles = [s.get("name") or "" for s in root.iter() if _local(s.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
        for no, sheet in enumerate(sheets):
            rows = []
            for row in ElementTree.fromstring(z.read(names[sheet])).iter():
                if _local(row.tag) != "row":
                    continue
                cells = [_cell(c, shared) for c in row if _local(c.tag) == "c"]
                if any(c.strip() for c in cells):
                    rows.append(cells)
            if rows:
                title = titles[no] if no < len(titles) and titles[no] else f"Sheet{no + 1}"
                parts += [f"--- Sheet: {title} ---", rows_to_text(rows)]
    return "\n".join(parts)


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(_texts(c))
    value = next(((v.text or "").strip() for v in c if _local(v.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else value
    return {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value


def xml_runs(xml: str) -> str:
    """SRC-17: visible text runs, joined by spaces."""
    runs = re.findall(r"<(?:a|w):t(?:\s[^>]*)?>(.*?)</(?:a|w):t>", xml, re.S)
    return re.sub(r"\s+", " ", " ".join(t for r in runs if (t := unescape(r).strip()))).strip()


def pptx_text(data: bytes) -> str:
    """Slides under their numbers with their notes; layouts, masters and notes where all slides are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        texts = {n.lower(): xml_runs(z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith(".xml")}
    slides = sorted((n for n in texts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    if not slides:
        raise ValueError("no slides")
    parts = []
    for name in slides:
        if texts[name]:
            note = texts.get(f"ppt/notesslides/notesslide{_number(name)}.xml", "")
            parts += [f"--- Slide {_number(name)} ---", texts[name], *([f"Notes: {note}"] if note and note != texts[name] else [])]
    if not parts:
        parts = [t for n, t in texts.items() if t and re.match(r"ppt/(slidelayouts|slidemasters|notesslides|diagrams/data)/", n)]
    if not parts:
        raise ValueError("no text")
    return "\n".join(parts)


def ole_text(data: bytes) -> str:
    """SRC-16: text atoms of a legacy presentation: record types 4000 (UTF-16) and 4008 (single bytes)."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("not a presentation")
    found = []
    for m in re.finditer(rb"(?:\xa0|\xa8)\x0f....", data, re.S):
        n, start = int.from_bytes(m[0][2:6], "little"), m.end()
        if 0 < n <= len(data) - start and n < 65536:
            body = data[start : start + n]
            text = body.decode("utf-16-le", "ignore") if m[0][0] == 0xA0 else body.decode("latin-1")
            if text.strip() and text.isprintable() or "\r" in text:
                found.append(text.replace("\r", "\n").strip())
    if not found:
        raise ValueError("no text")
    return "\n".join(found)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "docx": docx_text, "xlsx": xlsx_text, "csv": xlsx_text, "pptx": pptx_text,
    "ppt": lambda d: pptx_text(d) if d[:2] == b"PK" else ole_text(d),
}


def parse_office(files: DataFrame) -> DataFrame:
    """SRC-18: ``files`` (path, content binary) with text and error: the parser of the extension; text is null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                ext = path.rsplit(".", 1)[-1].lower()
                try:
                    if ext not in PARSERS:
                        raise ValueError(f"unsupported type .{ext}")
                    out.append((path, PARSERS[ext](bytes(content)), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


# --- JSON logs (SRC-22, SRC-23, SCL-17) -------------------------------------------------------------------------
LATENCY = T.StructType([T.StructField(c, T.DoubleType()) for c in ("retrieveMs", "documentHydrateMs", "llmMs", "verifyMs", "localCardMs", "routeMs", "totalMs")])
LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("kind", "traceId", "tier", "provider", "modelId", "modelName", "say", "captureScenario", "query", "reason", "result", "event", "failureCategory")]
    + [T.StructField("timestamp", T.LongType()), T.StructField("supported", T.BooleanType()), T.StructField("llmBypassed", T.BooleanType()), T.StructField("sourceCount", T.IntegerType()),
       T.StructField("latency", LATENCY), T.StructField("sileroProb", T.DoubleType()), T.StructField("durationMs", T.DoubleType()), T.StructField("energy", T.DoubleType()),
       T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
)


def read_log(lines: DataFrame, kinds: tuple[str, ...] = ("answer", "dropped", "feedback", "event")) -> DataFrame:
    """Records of a JSON-lines column ``value``, or of documents {"records": [...]}; lines that are neither, or of another kind, are dropped."""
    one = F.from_json("value", LOG_SCHEMA)
    many = F.from_json("value", T.StructType([T.StructField("records", T.ArrayType(LOG_SCHEMA))]))["records"]
    rows = lines.select(F.explode(F.coalesce(many, F.array(one))).alias("r")).select("r.*")
    return rows.filter(F.col("kind").isin(list(kinds)))


def write_ring(rows: DataFrame, path: str, order: str, cap: int = 2000) -> None:
    """SRC-24: append-only sink whose reader sees the last ``cap`` rows."""
    rows.write.mode("append").parquet(path)


def read_ring(spark: SparkSession, path: str, order: str, cap: int = 2000) -> DataFrame:
    """SRC-24: the last ``cap`` rows by order (a top-k, not a sort of the table)."""
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(cap)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """SRC-27: a table of a relational store; pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 8, **options) -> None:
    """SRC-27: rows to a table of a relational store, over at most ``partitions`` connections at a time."""
    rows.coalesce(partitions).write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()


def write_partitioned(rows: DataFrame, path: str, keys: list[str]) -> None:
    """SRC-25, SRC-26: a keyed store: one folder a key, replaced where the rows have it, others untouched."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def wav_bytes(samples: list[float], rate: int = 16_000) -> bytes:
    """SRC-31: a mono 16-bit WAV file."""
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.array(samples), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def claim_report(claims: DataFrame) -> DataFrame:
    """SRC-32: (meeting_id, report): a Markdown list of each meeting's claims by status and time."""
    line = F.concat(F.lit("- ["), "status", F.lit("] "), "speaker", F.lit(": "), "text")
    rows = claims.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line")))).alias("ls"), F.count("*").alias("n"),
                                            F.count_if(F.col("status") == "contradicted").alias("bad"))
    head = F.concat(F.lit("# Claims: "), F.col("n").cast("string"), F.lit(", contradicted: "), F.col("bad").cast("string"), F.lit("\n"))
    return rows.select("meeting_id", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("report"))


def session_receipt(items: DataFrame) -> DataFrame:
    """SRC-33, AGG-27: (session, answered, unsupported, text): questions in order, answered ones with their answer."""
    line = F.concat_ws(" ", F.concat(F.lit("Q: "), "question"), F.when(F.col("supported"), F.concat(F.lit("A: "), "say")).otherwise(F.lit("(no supported answer)")))
    rows = items.groupBy("session").agg(F.count_if("supported").alias("answered"), F.count_if(~F.col("supported")).alias("unsupported"),
                                        F.array_sort(F.collect_list(F.struct("ts", line.alias("line")))).alias("ls"))
    return rows.select("session", "answered", "unsupported", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def diagnostic_json(rows: DataFrame) -> DataFrame:
    """SRC-34: a JSON document a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def accept_batch(files: DataFrame, existing: DataFrame, max_count: int = 24, max_bytes: int = 40 << 20, max_file: int = 12 << 20) -> DataFrame:
    """SRC-21: (context_id, ord, path, verdict) of offered files: the first of a name only, while new ones fit the
    context's count and bytes; a replacement does not add. A context's list is folded in order, contexts apart.
    """
    have = existing.groupBy("context_id").agg(F.count("*").alias("n0"), F.sum("size").alias("b0"), F.collect_set("path").alias("paths"))
    none = F.array().cast("array<string>")
    lists = files.groupBy("context_id").agg(F.sort_array(F.collect_list(F.struct("ord", "path", "size"))).alias("fs")).join(have, "context_id", "left")
    kind = "array<struct<ord:bigint,path:string,verdict:string>>"
    zero = F.struct(F.coalesce("n0", F.lit(0)).alias("n"), F.coalesce("b0", F.lit(0)).cast("long").alias("b"), none.alias("seen"), F.array().cast(kind).alias("out"))

    def step(a: Column, f: Column) -> Column:
        old = F.array_contains(F.coalesce(F.col("paths"), none), f["path"])
        verdict = (
            F.when(F.coalesce(f["path"], F.lit("")) == "", "no name").when(F.array_contains(a["seen"], f["path"]), "duplicate name").when(f["size"] > max_file, "too large")
            .when(~old & (a["n"] >= max_count), "too many").when(~old & (a["b"] + f["size"] > max_bytes), "context full").otherwise(F.when(old, "replace").otherwise("accept"))
        )
        new = verdict == "accept"
        return F.struct(
            (a["n"] + new.cast("long")).alias("n"), (a["b"] + F.when(new, f["size"]).otherwise(0)).alias("b"),
            F.array_append(a["seen"], F.coalesce(f["path"], F.lit(""))).alias("seen"),
            F.array_append(a["out"], F.struct(f["ord"].cast("long").alias("ord"), f["path"].alias("path"), verdict.alias("verdict"))).alias("out"),
        )

    return lists.select("context_id", F.explode(F.aggregate("fs", zero, step)["out"]).alias("o")).select("context_id", "o.*")
