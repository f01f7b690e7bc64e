"""Aligners to choose from, or to add: each gives links for distinct pairs of token arrays, and can be cached."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import staging
from termweave.operators import vector_align
from termweave.operators.consistency import LINKS, heuristic_links, merge_links, once

#: Short names of encoders. Fixed values.
MODELS = {"bert": "bert-base-multilingual-cased", "xlmr": "xlm-roberta-base"}
#: Other names of the kinds, and the matching rules in the order they are preferred. Fixed values.
KINDS = {"mock": "table", "simalign": "matching", "awesome": "softmax"}
PREFERRED = ("iterated", "mutual", "weight")
Encoder = Callable[[DataFrame], DataFrame]


class Aligner(Protocol):
    name: str

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, tgt: arrays of tokens, each pair once) -> src, tgt, links."""
        ...


@dataclass(frozen=True)
class Heuristic:
    name: str = "heuristic"

    def links(self, pairs: DataFrame) -> DataFrame:
        return once(pairs.select("src", "tgt"), "links", heuristic_links(F.col("src"), F.col("tgt")))


@dataclass(frozen=True)
class Table:
    """Links from rows (src, tgt, links); none where a pair is missing."""

    table: DataFrame
    name: str = "table"

    def links(self, pairs: DataFrame) -> DataFrame:
        known = self.table.select("src", "tgt", "links").dropDuplicates(["src", "tgt"])
        return pairs.select("src", "tgt").join(known, ["src", "tgt"], "left").withColumn("links", F.coalesce("links", F.array().cast(LINKS)))


@dataclass(frozen=True)
class Vectors:
    """Links from sub-word vectors: encode adds src_vecs, tgt_vecs, src_word and tgt_word to the pairs."""

    encode: Encoder
    method: str
    model: str = MODELS["bert"]

    @property
    def name(self) -> str:
        return f"{self.method}:{self.model}"

    def links(self, pairs: DataFrame) -> DataFrame:
        keyed = self.encode(pairs.select("src", "tgt")).withColumn("pair", pair_key(F.col("src"), F.col("tgt")))
        return keyed.select("src", "tgt", "pair").join(vector_align.vector_links(keyed, "pair", self.method), "pair").select("src", "tgt", "links")


@dataclass(frozen=True)
class Ensemble:
    parts: tuple
    how: str = "intersect"

    def __post_init__(self):
        if not self.parts or self.how not in ("intersect", "union"):
            raise ValueError("one aligner at least; intersect or union")

    @property
    def name(self) -> str:
        return f"{self.how}({','.join(p.name for p in self.parts)})"

    def links(self, pairs: DataFrame) -> DataFrame:
        out = pairs.select("src", "tgt")
        for i, p in enumerate(self.parts):
            out = out.join(p.links(pairs).withColumnRenamed("links", f"l{i}"), ["src", "tgt"])
        return out.select("src", "tgt", merge_links([F.col(f"l{i}") for i in range(len(self.parts))], self.how).alias("links"))


@dataclass(frozen=True)
class Cache:
    """Links that stay: rows (aligner, key, links) in a folder that all executors share."""

    path: str

    @classmethod
    def temporary(cls, spark: SparkSession) -> Cache:
        return cls(staging.new_folder(spark))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        schema = f"aligner string, key string, links {LINKS}"
        if not staging.exists(spark, self.path):
            return spark.createDataFrame([], schema).select("key", "links")
        return spark.read.schema(schema).parquet(self.path).where(F.col("aligner") == name).dropDuplicates(["key"]).select("key", "links")

    def add(self, name: str, rows: DataFrame) -> None:
        rows.select(F.lit(name).alias("aligner"), "key", "links").write.mode("append").parquet(self.path)


@dataclass(frozen=True)
class Cached:
    """Aligns only what the cache lacks, each pair once; empty links are remembered too."""

    inner: Aligner
    cache: Cache = field(repr=False)

    @property
    def name(self) -> str:
        return self.inner.name

    def links(self, pairs: DataFrame) -> DataFrame:
        spark = pairs.sparkSession
        keyed = pairs.select("src", "tgt").withColumn("key", pair_key(F.col("src"), F.col("tgt")))
        missing = keyed.join(self.cache.read(spark, self.name), "key", "left_anti").dropDuplicates(["key"])
        if not missing.isEmpty():
            self.cache.add(self.name, self.inner.links(missing.select("src", "tgt")).withColumn("key", pair_key(F.col("src"), F.col("tgt"))))
        return keyed.join(self.cache.read(spark, self.name), "key").select("src", "tgt", "links")


def pair_key(src: Column, tgt: Column) -> Column:
    return F.md5(F.concat(F.array_join(src, "\u0001"), F.lit("\u0002"), F.array_join(tgt, "\u0001")))


def build_aligner(
    kind: str = "heuristic", model: str = "bert", encode: Encoder | None = None, methods: tuple[str, ...] = PREFERRED, table: DataFrame | None = None, parts: list[Aligner] | None = None, how: str = "intersect", cache: Cache | None = None
) -> Aligner:
    """An aligner by name: heuristic; table (or mock); matching (or simalign) and softmax (or awesome), which need an
    encoder; ensemble, of others. Cached where a cache is given. methods: matching rules that may be used, of which the
    first by preference is."""
    kind = KINDS.get(kind, kind)
    if kind == "heuristic":
        out: Aligner = Heuristic()
    elif kind == "table" and table is not None:
        out = Table(table)
    elif kind == "ensemble":
        out = Ensemble(tuple(parts or ()), how)
    elif kind in ("matching", "softmax") and encode is not None:
        rule = "softmax" if kind == "softmax" else next((m for m in PREFERRED if m in methods), None)
        if rule is None:
            raise ValueError(f"none of {PREFERRED} in {methods}")
        out = Vectors(encode, rule, MODELS.get(model, model))
    else:
        raise ValueError(f"no aligner {kind}, or what it needs is missing")
    return out if cache is None else Cached(out, cache)
