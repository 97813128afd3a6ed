"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once; the tokens' byte lengths give the token spans, which partition the text. Sections
(spans of characters, by default the lines) are joined with these spans as intervals inside the document, by binary
search. A token that crosses a boundary is allocated by an explicit rule:

* `first`, `last`: to the sections that hold its first, or last, byte; `split`: to each by its share of the bytes;
* `largest`: to the section that holds most of its bytes, the earlier one at a tie.

Documents are independent, so there is no shuffle and nothing is collected. Defined results: null and empty texts have
one empty line of no tokens, null section lists have no sections, null ends are the text's end; null or repeated ids
are passed through row by row; empty tables give an empty result; output names are fixed and other columns not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palletry.llm.common import slices

RULES = ("first", "last", "largest", "split")
_ENCODERS: dict[tuple[int, str], tuple] = {}


def token_table(source: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a `.tiktoken` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.splitlines()) if token}


def _encoder(source: bytes, pattern: str):
    """This worker's encoder and the byte length of each token id."""
    import tiktoken

    key = (hash(source), pattern)
    if key not in _ENCODERS:
        ranks = token_table(source)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[key] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[key]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its newline; an empty text is one empty line."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    starts = np.r_[0, ends[:-1]]
    if len(ends) > 1 and starts[-1] == ends[-1]:
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def byte_offsets(text: str, raw: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    at = np.clip(at, 0, len(text))
    if len(raw) == len(text):
        return at
    first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.r_[first, len(raw)][at]


def allocated(bounds: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each byte span [start, end); token i covers bytes bounds[i] to bounds[i+1]."""
    end = np.maximum(start, end)
    if rule == "split":
        number = np.arange(len(bounds), dtype=float)
        return np.interp(end, bounds, number) - np.interp(start, bounds, number)
    if rule == "first":
        return (np.searchsorted(bounds[:-1], end) - np.searchsorted(bounds[:-1], start)).astype(float)
    if rule == "last":
        return (np.searchsorted(bounds[1:], end, "right") - np.searchsorted(bounds[1:], start, "right")).astype(float)
    inside = np.searchsorted(bounds, end, "right") - 1 - np.searchsorted(bounds, start)
    count = np.maximum(inside, 0).astype(float)
    crossing: dict[int, list[tuple[int, int, int]]] = {}
    for s in range(len(start)):
        if start[s] == end[s]:
            continue
        for t in {int(np.searchsorted(bounds, start[s], "right")) - 1, int(np.searchsorted(bounds, end[s])) - 1}:
            if bounds[t] < start[s] or bounds[t + 1] > end[s]:
                overlap = min(bounds[t + 1], end[s]) - max(bounds[t], start[s])
                crossing.setdefault(t, []).append((-int(overlap), int(start[s]), s))
    for t, found in crossing.items():
        whole = [s for s in range(len(start)) if start[s] <= bounds[t] and bounds[t + 1] <= end[s]] if len(found) == 1 else []
        if not whole:
            count[min(found)[2]] += 1
    return count


def section_tokens(
    df: DataFrame, model_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first"
) -> DataFrame:
    """(id, section, name, start, end, n_tokens, doc_tokens): one row for each section of each document.

    `sections_col`: an array of structs (name, start, end), in characters; without it the lines are the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(model_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[id_col]
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if sections_col:
        columns.append(F.transform(F.col(sections_col), lambda s: F.struct(s["name"].cast("string").alias("name"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoder(shipped.value, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections_col else None
            for lo in range(0, len(texts), 512):
                row, nth, names, starts, ends, counts, totals = [], [], [], [], [], [], []
                for i in range(lo, min(lo + 512, len(texts))):
                    text = texts[i] or ""
                    if given is None:
                        start, end = line_spans(text)
                        name = [None] * len(start)
                    else:
                        parts = given[i] or []
                        name = [p["name"] for p in parts]
                        start = np.array([p["start"] or 0 for p in parts], np.int64)
                        end = np.array([len(text) if p["end"] is None else p["end"] for p in parts], np.int64)
                    raw = text.encode()
                    bounds = np.zeros(1, np.int64)
                    if raw:
                        bounds = np.r_[0, np.cumsum(sizes[np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)])]
                    row.append(np.full(len(start), i))
                    nth.append(np.arange(len(start)))
                    names += name
                    starts.append(start)
                    ends.append(end)
                    counts.append(allocated(bounds, byte_offsets(text, raw, start), byte_offsets(text, raw, end), rule))
                    totals.append(np.full(len(start), len(bounds) - 1))
                whole = [np.concatenate(x) for x in (row, nth, starts, ends, counts, totals)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(whole[0])), pa.array(whole[1].astype(np.int32)), pa.array(names, pa.string())]
                    + [pa.array(x.astype(np.int64)) for x in whole[2:4]]
                    + [pa.array(whole[4].astype(float)), pa.array(whole[5].astype(np.int64))],
                    ["id", "section", "name", "start", "end", "n_tokens", "doc_tokens"],
                )

    return df.select(columns).mapInArrow(run, f"id {kind}, section int, name string, start long, end long, n_tokens double, doc_tokens long")
