"""Language-model judging over HTTP, off unless a model is configured. Keys stay out of plans and logs."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Judge:
    base_url: str
    model: str
    api_key: str = field(default="", repr=False)
    provider: str = "auto"
    timeout: float = 60

    def kind(self) -> str:
        return ("anthropic" if "anthropic.com" in self.base_url else "openai") if self.provider == "auto" else self.provider

    def endpoint(self) -> str:
        """The address that answers: as given if it ends there, else with what is missing."""
        url = self.base_url.rstrip("/")
        end = "/messages" if self.kind() == "anthropic" else "/chat/completions"
        return url if url.endswith(end) else url + end if url.endswith("/v1") else url + "/v1" + end

    def request(self, ngram: str, spans: list[str]) -> urllib.request.Request:
        system = (
            "You review translations. You get a source term and the different ways it was translated. If a reader could take them for different things, "
            'the verdict is "inconsistent"; if they differ only as grammar or style asks, it is "acceptable". Reply with one JSON object and nothing else, '
            'with the keys "verdict", "preferred" (the best rendering) and "reason" (one sentence).'
        )
        asked = f"Term: {ngram}\n" + "\n".join(f"- {s}" for s in spans)
        if self.kind() == "anthropic":
            body, head = {"model": self.model, "max_tokens": 400, "system": system, "messages": [{"role": "user", "content": asked}]}, {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}
        else:
            body, head = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": asked}]}, {"Authorization": f"Bearer {self.api_key}"}
        return urllib.request.Request(self.endpoint(), json.dumps(body).encode(), {"Content-Type": "application/json"} | head)

    def ask(self, ngram: str, spans: list[str]) -> tuple[str | None, str | None]:
        """(reply, error)"""
        try:
            with urllib.request.urlopen(self.request(ngram, spans), timeout=self.timeout) as r:
                d = json.load(r)
            return (d["content"][0]["text"] if self.kind() == "anthropic" else d["choices"][0]["message"]["content"]), None
        except (urllib.error.URLError, OSError, KeyError, IndexError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"


def judge_all(items: DataFrame, judge: Judge, at_once: int = 4) -> DataFrame:
    """place, key, ngram, reply, error for each item (key, ngram, spans); so many requests run at a time. place keeps the
    order of the items; one that fails has an error and stops no other."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            d = batch.to_pydict()
            got = [judge.ask(n, s) for n, s in zip(d["ngram"], d["spans"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.string())], names=["place", "key", "ngram", "reply", "error"])

    numbered = items.select(F.monotonically_increasing_id().alias("place"), "key", "ngram", "spans")
    return numbered.repartition(at_once).mapInArrow(run, "place bigint, key string, ngram string, reply string, error string").orderBy("place")


def test_connection(judge: Judge) -> dict:
    """Whether the judge answers about a term with two translations, and what it said."""
    reply, error = judge.ask("test", ["اختبار", "تجربة"])
    return {"ok": error is None, **({"sample": reply} if error is None else {"error": error})}


test_connection.__test__ = False  # no test of pytest's
