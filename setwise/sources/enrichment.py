"""Batches of rows sent to a remote service and merged with its replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def http_transport(url: str, timeout: float = 30.0) -> Callable[[list], list]:
    """POST a JSON array, expect a JSON array of as many elements."""

    def send(rows: list) -> list:
        import urllib.request

        req = urllib.request.Request(url, json.dumps({"data": rows}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.load(r)["data"]

    return send


def enrich(df: DataFrame, transport: Callable[[list], list], schema: str, batch: int = 500) -> DataFrame:
    """df with the columns of `schema` from transport's replies; a null reply leaves its row out. One call a batch, made on the executors."""
    added = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    kept = [c for c in df.columns if c not in added]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                replies = transport(json.loads(part.to_json(orient="records", date_format="iso")))
                if len(replies) != len(part):
                    raise ValueError(f"{len(part)} rows sent, {len(replies)} replies")
                ok = [r is not None for r in replies]
                extra = pd.DataFrame([[r.get(c) for c in added] for r in replies if r is not None], columns=added)
                yield pd.concat([part[kept][ok].reset_index(drop=True), extra], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    return df.mapInPandas(run, f"{fields}, {schema}" if fields else schema)


def enrich_set(alg, s, options, transport=None):
    """For the language: each value of a set with what a service at {url: ...} replies for it, as JSON; a null reply leaves the value out."""
    from pyspark.sql import functions as F

    from ..errors import CompileError
    from ..functions import values as V

    url = options.val.fields.get("url")
    if url is None or not isinstance(url.lit, str):
        raise CompileError("a constant url is needed")
    send = transport or http_transport(url.lit)
    name = f"en{next(alg.count)}"

    def f(val, ids: list[str]):
        def make(df: DataFrame) -> DataFrame:
            sent = df.select(*ids, F.to_json(F.struct(V.column(val).alias("v"))).alias(name))

            def run(frames: Iterator) -> Iterator:
                import pyarrow as pa

                for b in frames:
                    rows = [json.loads(x).get("v") for x in b.column(len(ids)).to_pylist()]
                    out = []
                    for lo in range(0, len(rows), 500):
                        replies = send(rows[lo : lo + 500])
                        if len(replies) != len(rows[lo : lo + 500]):
                            raise ValueError(f"{len(rows[lo : lo + 500])} rows sent, {len(replies)} replies")
                        out += [None if r is None else json.dumps(r) for r in replies]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], pa.array(out, pa.string())], names=[*ids, name])

            got = sent.mapInArrow(run, sent.schema).where(F.col(name).isNotNull())
            return got.select(*ids, F.parse_json(name).alias(name))

        return make, V.Val("variant", F.col(name))

    return alg.morph(s, f)
