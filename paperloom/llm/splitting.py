"""Splitting oversized items at natural boundaries, by dynamic programming over boundary positions.

A cut costs by what stands there (blank line, line break, sentence end, clause, word, bare character) and a piece by
how far its new text is from an even share; the program takes the cheapest cuts under the limit. Every boundary is a
position of the program. Bare characters are no natural boundaries: all of a stretch are positions if it has none in
``REACH`` characters, so the program always has a solution.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.nested import parse_json

#: Characters without any boundary after which bare characters are positions, too.
REACH = 200
#: What cuts cost, the strongest boundary first, and where each may fall (after the match).
LEVELS = (
    (0.0, re.compile(r"(?:\r?\n|\r)[^\S\n\r]*(?:\r?\n|\r)\s*")),
    (0.4, re.compile(r"[\r\n  ]+[^\S\n\r]*")),
    (0.8, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？．।؟۔]+[”’」』）»)\]]*\s*")),
    (2.0, re.compile(r"[,;:](?=\s)\s+|[，；：、،؛]\s*|\s[–—-]\s")),
    (4.0, re.compile(r"\s+")),
)
HARD = 8.0
#: Characters that stay with the one before them.
STICKY = re.compile(r"[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎ً-ٟ‌‍︀-️⃐-⃿\U0001f3fb-\U0001f3ff]|(?<=\r)\n")


def boundaries(text: str, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending and without its ends, and what each costs. ``fresh`` is the
    longest new text of a piece; no two neighbouring positions are farther apart."""
    n = len(text)
    reach = min(REACH, max(1, fresh // 4))
    found = [np.array([m.end() for m in pattern.finditer(text)], np.int64) for _, pattern in LEVELS]
    at = np.concatenate(found)
    price = np.repeat([p for p, _ in LEVELS], [len(x) for x in found])
    at, first = np.unique(at, return_index=True)  # of equal positions the first, which is of the strongest level
    price = price[first]
    inner = (at > 0) & (at < n)
    at, price = at[inner], price[inner]
    ends = np.concatenate(([0], at, [n]))
    bare = []
    for k in np.flatnonzero(np.diff(ends) > reach).tolist():
        a, b = int(ends[k]), int(ends[k + 1])
        last = a
        for x in range(a + 1, b):
            if not STICKY.match(text, x) or x - last >= reach:
                bare.append(x)
                last = x
    at, price = np.concatenate((at, np.array(bare, np.int64))), np.concatenate((price, np.full(len(bare), HARD)))
    order = np.argsort(at, kind="stable")
    return at[order], price[order]


def split_points(text: str, limit: int = 1200, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, each at most ``limit`` long and, after the first, beginning ``overlap``
    before the end of the one before it. A text within the limit is one piece; an empty one has none."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    fresh = limit - overlap
    even = n / (1 + -(-(n - limit) // fresh))
    at, price = boundaries(text, fresh)
    keep = at >= overlap
    at, price = np.concatenate(([0], at[keep], [n])), np.concatenate(([0.0], price[keep], [0.0]))
    # a piece's own cost by its length
    size = 1.0 + 6.0 * (np.arange(limit + 1) / even - 1.0) ** 2
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    low, places, prices = 0, at.tolist(), price.tolist()
    for i in range(1, len(places)):
        x = places[i]
        while x - places[low] > (fresh if low else limit):
            low += 1
        if low < i:
            total = size[x - at[low:i]]
            total += best[low:i]
            j = int(total.argmin())
            best[i], back[i] = total[j] + prices[i], low + j
    if not np.isfinite(best[-1]):
        raise ValueError("no cuts within the limit")
    cuts, i = [n], len(at) - 1
    while i:
        i = int(back[i])
        cuts.append(int(at[i]))
    cuts.reverse()
    return [(max(0, a - overlap), b) for a, b in zip(cuts, cuts[1:])]


def items_of(text: str | None, list_key: str, text_key: str) -> Iterator[tuple[str | None, str]]:
    """(id, text) of the items of a JSON text: an array of objects, or an object that has it under ``list_key``."""
    try:
        value = parse_json(text) if text else None
    except ValueError:
        return
    if isinstance(value, dict):
        value = value.get(list_key)
    for item in value if isinstance(value, list) else [value] if isinstance(value, dict) else ():
        if isinstance(item, dict) and isinstance(item.get(text_key), str):
            own = item.get("id")
            yield own if own is None or isinstance(own, str) else json.dumps(own), item[text_key]


def _clean(text: str | None) -> str | None:
    """The text with what UTF-8 can't hold (lone surrogates) replaced."""
    return text and text.encode("utf-8", "replace").decode()


def split_items(
    df: DataFrame, id_col: str, json_col: str, list_key: str, text_key: str, limit: int = 1200, overlap: int = 100, with_text: bool = True
) -> DataFrame:
    """(record_id, item_id, item_no int, piece_no int, n_pieces int, start_at int, end_at int[, piece string]): the
    pieces of every item in the JSON of every row.

    Positions are code points of the decoded text. A null or damaged JSON, one without items, and an item whose text
    is missing, null or empty give no row. Repeated rows give repeated rows; other columns are not read. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = dict(df.dtypes)[id_col]
    fields = ["item_id", "item_no", "piece_no", "n_pieces", "start_at", "end_at"] + ["piece"] * with_text
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 64):
                rows, own = [], []
                for k, text in enumerate(texts.slice(at, 64).to_pylist()):
                    for no, (item, content) in enumerate(items_of(text, list_key, text_key)):
                        item = _clean(item)
                        places = split_points(content, limit, overlap)
                        for p, (a, b) in enumerate(places):
                            own.append(at + k)
                            rows.append((item, no, p, len(places), a, b, _clean(content[a:b])) if with_text else (item, no, p, len(places), a, b))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(fields), types)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own, pa.int64())), *columns], names=["record_id", *fields])

    schema = f"record_id {kind}, item_id string, item_no int, piece_no int, n_pieces int, start_at int, end_at int" + ", piece string" * with_text
    return df.select(id_col, json_col).mapInArrow(run, schema)


def split_tables(artifacts: DataFrame, memories: DataFrame, limit: int = 1200, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """``split_items`` over the blocks of layout artifacts and the elements of memories, with record_table first."""
    parts = [
        split_items(df, "id", column, key, text, limit, overlap, with_text).withColumn("record_table", F.lit(name))
        for df, name, column, key, text in (
            (artifacts, "paper_layout_artifact", "blocks_json", "blocks", "text"),
            (memories, "paper_memory", "structure_json", "elements", "content"),
        )
    ]
    return parts[0].unionByName(parts[1])


def oversized_items(pieces: DataFrame) -> DataFrame:
    """(record_table, record_id, item_id): the items that were cut, each once."""
    return pieces.filter("n_pieces > 1").select("record_table", "record_id", "item_id").distinct()
