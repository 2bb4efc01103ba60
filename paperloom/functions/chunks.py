"""Cutting and packing texts: chunks at separators, batches under two limits, protected spans, mathematical notation."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where chunks may end, the best first.
SEPARATORS = ("\n\n", "\n", "。", ". ", "; ")
#: Spans that a translation must leave as they are.
PROTECTED = r"(`[^`]+`|\$[^$]+\$|https?://\S+|10\.\d{4,9}/\S+|\[\d+(?:[,–-]\d+)*\]|\d+(?:\.\d+)?\s?(?:%|ms|kg|km|cm|mm|GB|MB|Hz))"
#: Symbols and their LaTeX commands.
SYMBOLS = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega",
    "Σ": r"\Sigma", "Ω": r"\Omega", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "×": r"\times", "·": r"\cdot", "±": r"\pm", "∞": r"\infty", "∑": r"\sum", "∏": r"\prod",
    "∫": r"\int", "√": r"\sqrt", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "∪": r"\cup", "∩": r"\cap", "→": r"\to", "∂": r"\partial", "∇": r"\nabla", "ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}",
}


def cut_text(text: str | None, most: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``most`` characters, each ending after the best separator in its second half
    if there is one."""
    out, at = [], 0
    n = len(text or "")
    while n - at > most:
        end = at + most
        for s in SEPARATORS:
            k = text.rfind(s, at + most // 2, end)
            if k >= 0 and k + len(s) <= end:
                end = k + len(s)
                break
        out.append((at, end))
        at = end
    return [*out, (at, n)] if n > at else out


def chunk_texts(df: DataFrame, id_col: str, text_col: str, most: int = 8000) -> DataFrame:
    """(id, chunk_no, start_at, end_at): the chunks of every row's text; null and empty texts give none."""
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, a, b) for i, t in zip(pdf[id_col], pdf[text_col]) for k, (a, b) in enumerate(cut_text(t, most))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "start_at", "end_at"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, chunk_no int, start_at int, end_at int")


def batches(df: DataFrame, group: str, order: list[str], size: str, items: int = 50, total: int = 48 * 1024) -> DataFrame:
    """Rows with the batch they fall into, filled in order: a batch closes when another row would exceed the number of
    items or the total size. A row over the total is a batch of its own. One task a group; groups must be bounded."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", batch int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out, batch, n, used = [], 0, 0, 0
        for s in pdf[size]:
            if n and (n >= items or used + s > total):
                batch, n, used = batch + 1, 0, 0
            out.append(batch)
            n, used = n + 1, used + s
        return pdf.assign(batch=out)

    return df.groupBy(group).applyInPandas(fold, schema)


def protect(c: Column) -> Column:
    """The text with its protected spans marked; ``restore`` takes the marks off again."""
    return F.regexp_replace(c, PROTECTED, "<keep>$1</keep>")


def restore(c: Column) -> Column:
    """The text without marks."""
    return F.regexp_replace(c, r"</?keep>", "")


def latex_of(text: str | None) -> tuple[str | None, str]:
    """(LaTeX, state) of a line of Unicode mathematics: READY, APPROXIMATE if a symbol is left over, UNAVAILABLE if
    there is nothing mathematical."""
    if not text:
        return None, "UNAVAILABLE"
    out, seen, left = [], False, False
    for c in unicodedata.normalize("NFC", text):
        plain = unicodedata.normalize("NFKC", c)
        tag = unicodedata.decomposition(c)
        if c in SYMBOLS or plain in SYMBOLS:
            out.append(SYMBOLS.get(c, SYMBOLS.get(plain)) + " ")
            seen = True
        elif tag.startswith("<super>") or tag.startswith("<sub>"):
            out.append(("^{" if tag.startswith("<super>") else "_{") + plain + "}")
            seen = True
        elif c != plain and plain.isalnum():
            out.append(plain)
            seen = True
        else:
            left |= ord(c) > 127 and unicodedata.category(c) == "Sm"
            seen |= unicodedata.category(c) == "Sm"
            out.append(c)
    return ("".join(out).strip(), "APPROXIMATE" if left else "READY") if seen else (None, "UNAVAILABLE")


def transcribe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, latex, state) of every row."""
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [latex_of(t) for t in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "latex": [x for x, _ in found], "state": [s for _, s in found]})

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, latex string, state string")


def clean_latex(c: Column) -> Column:
    """LaTeX without fences, delimiters and control characters; null if nothing or more than 4 000 characters is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"```[a-z]*", ""), r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}]", "")
    ends = r"^\s+|\s+$"
    bare = F.regexp_replace(F.regexp_replace(bare, ends, ""), r"^(?:\$\$?|\\\[|\\\()|(?:\$\$?|\\\]|\\\))$", "")
    bare = F.regexp_replace(bare, ends, "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= 4000), bare)


def compacted(text: str | None, depth: int = 4, items: int = 20, characters: int = 200) -> str | None:
    """JSON cut to a depth, a number of items a level and a length of strings; damaged JSON gives null."""

    def cut(v, d):
        if isinstance(v, dict):
            return {k: cut(x, d - 1) for k, x in list(v.items())[:items]} if d else "…"
        if isinstance(v, list):
            return [cut(x, d - 1) for x in v[:items]] if d else "…"
        return v[:characters] + "…" if isinstance(v, str) and len(v) > characters else v

    try:
        return json.dumps(cut(json.loads(text), depth), ensure_ascii=False) if text else None
    except (ValueError, RecursionError):
        return None


_REF = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}")


def resolve_template(template: str, values: dict) -> str:
    """A template with its {{a.b}} references replaced by the values they lead to; unknown ones become empty."""

    def look(m: re.Match) -> str:
        at = values
        for part in m[1].split("."):
            at = at.get(part, "") if isinstance(at, dict) else ""
        return at if isinstance(at, str) else json.dumps(at)

    return _REF.sub(look, template)
