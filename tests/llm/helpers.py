"""Small frames shared by the operator tests."""

from __future__ import annotations

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"


def small(name: str) -> list[dict]:
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def docs(spark, texts, ids=None, extra: str = ""):
    """doc_id, text, lang, source, n_chars and a column with a clashing name."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 2}", len(t or ""), "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra or 'key'} string")


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
