"""Side inputs: glossaries (CSV, TBX), gold alignments, and the small JSON stores of vault and decisions."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.sources.xliff import flat, name
from termweave.staging import exists, read_text, write_text

#: First cells that make a row a header. Fixed values.
HEADER = ("source", "english", "term", "en")
ENTRY = "key string, source string, target string, updated string, deleted boolean"
DECISION = "key string, ngram string, status string, note string, updated string"


def parse_csv(content: bytes) -> list[tuple[str, str]]:
    """Pairs of rows of two cells at least, trimmed, without blanks and header words."""
    out = []
    for row in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")):
        if len(row) >= 2 and (s := row[0].strip()) and (t := row[1].strip()) and s.lower() not in HEADER:
            out.append((s, t))
    return out


def parse_tbx(content: bytes) -> list[tuple[str, str]]:
    out = []
    for entry in ElementTree.fromstring(content).iter():
        if not name(entry).endswith("termEntry"):
            continue
        terms = {}
        for part in entry.iter():
            if name(part) in ("langSet", "langSec"):
                lang = next((v for k, v in part.attrib.items() if k.rsplit("}", 1)[-1] == "lang"), "")[:2].lower()
                term = next((x for x in part.iter() if name(x).endswith("term")), None)
                if term is not None:
                    terms[lang] = flat(term)
        if terms.get("en") and terms.get("ar"):
            out.append((terms["en"], terms["ar"]))
    return out


def parse_glossaries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target), and (file, error) of bad files, of rows file, content (bytes): TBX by its ending, else CSV."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows, errors = [], []
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append([{"source": s, "target": t} for s, t in (parse_tbx if is_tbx(file) else parse_csv)(content)])
                    errors.append(None)
                except Exception as e:  # a bad file is reported, others survive
                    rows.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(rows, kind)], names=["file", "error", "rows"])

    parsed = files.select("file", "content").mapInArrow(run, "file string, error string, rows array<struct<source:string,target:string>>")
    return parsed.select(F.explode("rows").alias("x")).select("x.*"), parsed.where("error is not null").select("file", "error")


def is_tbx(path: str) -> bool:
    return path.lower().endswith((".tbx", ".xml"))


def glossary_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_glossaries(spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a glossary, CSV or TBX."""
    return glossary_files(spark, path)[0]


def gold(spark: SparkSession, path: str) -> DataFrame:
    """src, tgt (tokens), sure, poss of a tab-separated file: i-j sure, i?j possible; # lines are comments."""
    return gold_rows(spark.read.text(path))


def gold_rows(lines: DataFrame) -> DataFrame:
    """The same from rows of value."""
    parts = F.split("value", "\t")
    rows = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')").where(F.size(parts) >= 3)
    links = T.tokens(F.get(parts, F.lit(2)))

    def pairs(pattern: str):
        return F.transform(F.filter(links, lambda x: x.rlike(f"^[0-9]+{pattern}[0-9]+$")), lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("s"), F.regexp_extract(x, "([0-9]+)$", 1).cast("int").alias("t")))

    return rows.select(T.tokens(F.get(parts, F.lit(0))).alias("src"), T.tokens(F.get(parts, F.lit(1))).alias("tgt"), pairs("-").alias("sure"), pairs(r"[-?]").alias("poss"))


def load_store(spark: SparkSession, path: str) -> dict:
    """A JSON store, from any file system Spark reads; empty where it is missing or no object. A bare map of entries
    counts as one."""
    if not exists(spark, path):
        return {"entries": {}}
    try:
        data = json.loads(read_text(spark, path))
    except ValueError:
        return {"entries": {}}
    if not isinstance(data, dict):
        return {"entries": {}}
    return data if isinstance(data.get("entries"), dict) else {"entries": data}


def save_store(spark: SparkSession, path: str, data: dict) -> None:
    """Rewrites the store whole."""
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2))


def vault(spark: SparkSession, path: str) -> DataFrame:
    d = load_store(spark, path)
    rows = [(k, e.get("source", ""), e.get("target", ""), e.get("updated", ""), gone) for part, gone in (("entries", False), ("trash", True)) for k, e in (d.get(part) or {}).items() if isinstance(e, dict)]
    return spark.createDataFrame(rows, ENTRY)


def save_vault(frame: DataFrame, path: str) -> None:
    """The reviewers' own list: small, and kept as one file."""
    out = {"entries": {}, "trash": {}}
    for r in frame.orderBy("key").collect():
        out["trash" if r["deleted"] else "entries"][r["key"]] = {c: r[c] for c in ("source", "target", "updated")}
    save_store(frame.sparkSession, path, out)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    rows = [(k, e.get("ngram", ""), e.get("status", ""), e.get("note", ""), e.get("updated", "")) for k, e in load_store(spark, path)["entries"].items() if isinstance(e, dict)]
    return spark.createDataFrame(rows, DECISION)


def save_decisions(frame: DataFrame, path: str) -> None:
    save_store(frame.sparkSession, path, {"entries": {r["key"]: {c: r[c] for c in ("ngram", "status", "note", "updated")} for r in frame.orderBy("key").collect()}})


def vault_csv(frame: DataFrame) -> str:
    """The live entries as CSV text with a byte-order mark, by key."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(["source", "target"])
    w.writerows((r["source"], r["target"]) for r in frame.where("not deleted").orderBy("key").collect())
    return "﻿" + out.getvalue()


def import_vault(spark: SparkSession, path: str) -> DataFrame:
    """source, target pairs of a JSON store or else a glossary CSV."""
    entries = load_store(spark, path)["entries"] if path.lower().endswith(".json") else None
    if entries is None:
        return glossary(spark, path)
    return spark.createDataFrame([(e["source"], e["target"]) for e in entries.values() if isinstance(e, dict) and e.get("source") and e.get("target")], "source string, target string")
