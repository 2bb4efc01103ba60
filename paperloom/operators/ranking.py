"""The best sources of many requests in one pass: an Arrow function that keeps k sources a request in every task.

Pairs of requests and sources are never rows. A task takes its sources in chunks of bounded size, sorted by page and id,
which is the order of ties; a chunk has a list of rows for every token of the requests, and a byte a row for the tokens
that many rows have. Requests that share tokens with many others, as many tokens and the same limits are a group: it adds up
its tokens' bytes and takes the rows of the highest levels, each from its first row on, until it has k or no level can
enter its k best. What a request has beside its group (tokens that few requests have, phrases, numbers, beginnings) concerns
few rows, which are scored on their own and kept if they can be among its k best. So a task gives k rows a group and k of
a request's own at most, however many sources share a token.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a chunk, and tokens of the requests in them, beyond which it is closed.
ROWS, PAIRS = 1 << 15, 4 << 20
#: A token that more than one row in so many has is kept as a byte a row.
DENSE = 64
#: A token is shared if so many requests have it.
SHARED = 16
#: Pairs of a request and a row that are compared at once.
EXPANDED = 1 << 20
#: Bits of the routes.
PHRASE, LEXICAL, FORMULA, FIGURE, SECTION = 1, 2, 4, 8, 16
NONE = np.empty(0, np.int64)


@lru_cache(1 << 16)
def rounded(x: float) -> float:
    """Six decimals, halves away from zero, as the engine rounds; at most 1."""
    return float(Decimal(repr(min(x, 1.0))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@lru_cache(1 << 10)
def levels(size: int) -> tuple[tuple[float, bool, int], ...]:
    """(score, by the section alone, tokens) of a request of so many tokens, the best first."""
    text = [(rounded(0.72 * (v / size)), False, v) for v in range(1, size + 1)]
    return tuple(sorted(text + [(rounded(0.35 + 0.55 * (v / size)), True, v) for v in range(1, size + 1)], key=lambda x: -x[0]))


def among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """A column of lists of words as numbers: those of row i are at[offsets[i] : offsets[i + 1]]."""

    def __init__(self, column: pa.ChunkedArray):
        own = column.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(own).cast(pa.string()).dictionary_encode()
        self.words, self.at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.owners = np.repeat(np.arange(len(lengths)), lengths)

    def count(self, lists: Lists, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many words of each request the row beside it has."""
        out = np.zeros(len(own), np.int64)
        for j in range(int(self.sizes[own].max(initial=0))):
            some = np.flatnonzero(self.sizes[own] > j)
            out[some] += lists.have(self.at[self.offsets[own[some]] + j], rows[some])
        return out


def grouped(requests: pa.Table) -> pa.Table:
    """Requests with ``shared``, their tokens that many of them have, and ``group``: the first request that shares the same,
    is as long and has the same limits. A group's rows are those of each member but for the rows that have other tokens of
    it. Null: marks alone, no shared token, or a request for numbered formulas only."""
    r = {c: requests.column(c).to_pylist() for c in requests.column_names}
    often = Counter(x for own in r["tokens"] for x in own or ())
    limits = [r.get(c, [None] * len(r["req"])) for c in ("types", "first_page", "last_page")]
    shared, group, first = [], [], {}
    for req, cq, tokens, formulas, types, *pages in zip(r["req"], r["cq"], r["tokens"], r["q_formulas"], *limits, strict=True):
        own = sorted(x for x in tokens or () if often[x] >= SHARED) if cq and not (formulas and "FORMULA" in (types or ())) else []
        shared.append(own)
        group.append(first.setdefault((tuple(own), len(tokens), kinds_of(types), *pages), req) if own else None)
    return requests.append_column("shared", pa.array(shared, pa.list_(pa.string()))).append_column("group", pa.array(group, pa.int64()))


def kinds_of(types: list[str | None] | None) -> tuple[str, ...] | None:
    """The kinds that a request allows; none: all."""
    return tuple(sorted({x for x in types if x is not None})) if types else None


class Lists:
    """Rows in order for every key, from pairs (key, row)."""

    def __init__(self, keys: list[np.ndarray], rows: list[np.ndarray], place: np.ndarray):
        k, r = (np.concatenate(x).astype(np.int64) if x else NONE for x in (keys, rows))
        self.n = max(len(place), 1)
        self.both = np.unique(k * self.n + place[r]) if len(k) else NONE
        self.rows = self.both % self.n
        found, starts = np.unique(self.both // self.n, return_index=True)
        ends = np.append(starts[1:], len(self.both))[: len(starts)]
        self.found, self.starts, self.ends = found, starts, ends
        self.at = dict(zip(found.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))

    def __getitem__(self, key: int) -> np.ndarray:
        at = self.at.get(key)
        return self.rows[at[0] : at[1]] if at else NONE

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's rows begin, and how many there are."""
        if not len(self.found):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.found, keys), len(self.found) - 1)
        return self.starts[at], np.where(self.found[at] == keys, self.ends[at] - self.starts[at], 0)

    def have(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which pairs (key, row) there are; a negative key has none."""
        return among(self.both, np.where(keys < 0, -1, keys * self.n + rows))


class Counts:
    """How many of some tokens each row has."""

    def __init__(self, lists: Lists, n: int):
        self.lists, self.n, self.bytes = lists, n, {}

    def __call__(self, tokens: list[int]) -> np.ndarray | None:
        """A count a row; none if no row has any."""
        out, kind = None, np.uint8 if len(tokens) < 256 else np.int32
        for t in tokens:
            rows = self.lists[t]
            if not len(rows):
                continue
            if out is None:
                out = np.zeros(self.n, kind)
            if len(rows) * DENSE <= self.n:
                out[rows] += 1
                continue
            if (own := self.bytes.get(t)) is None:
                own = self.bytes[t] = np.zeros(self.n, np.uint8)
                own[rows] = 1
            out += own
        return out


class Beginnings:
    """Texts in order, for the lengths of common beginnings."""

    def __init__(self, sides: list[tuple[str, int]], place: np.ndarray):
        sides = sorted(sides)
        self.texts, self.rows = [t for t, _ in sides], place[np.array([r for _, r in sides], np.int64)] if sides else NONE

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share at least the first character, and how many they share."""
        low, high, first, n = 0, len(self.texts), (0, 0), None
        for i in range(1, len(text) + 1):
            cut = lambda t, i=i: t[:i]
            low, high = bisect_left(self.texts, text[:i], low, high, key=cut), bisect_right(self.texts, text[:i], low, high, key=cut)
            if low == high:
                break
            if n is None:
                first, n = (low, high), np.zeros(high - low, np.int64)
            n[low - first[0] : high - first[0]] = i
        return self.rows[first[0] : first[1]], n if n is not None else NONE


def _pairs(column: pa.Array, words: pa.Array, base: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the known words in a column of lists; but: rows that count as empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    keys = pc.fill_null(pc.index_in(pc.list_flatten(column), value_set=words), -1).to_numpy(zero_copy_only=False)
    known = keys >= 0
    if but is not None:
        known &= ~but[rows]
    return keys[known], rows[known] + base


class Matcher:
    """The k best sources of every request of a block: feed it batches of sources, then take ``lists`` or ``rows``.

    What many requests share is looked up once for all of them, a group; a request's own rows are those that have one of its
    other tokens, its phrase or a number of it, as far as they can be among its k best beside its group's.
    """

    def __init__(self, requests: pa.Table, k: int):
        if "group" not in requests.column_names:
            requests = grouped(requests)
        self.k = k
        r = {c: requests.column(c).to_pylist() for c in requests.column_names if c in ("q", "cq", "types", "first_page", "last_page")}
        self.req = requests.column("req").combine_chunks().to_numpy().astype(np.int64)
        size = len(self.req)
        self.words = {c: Words(requests.column(c)) for c in ("tokens", "q_formulas", "q_figures")}
        self.size_of = self.words["tokens"].sizes
        number = lambda values: {x: i for i, x in enumerate(dict.fromkeys(values))}
        phrases, wholes = number(r["q"]), number(x for x in r["cq"] if x)
        self.q_at, self.cq_at = np.array([phrases[x] for x in r["q"]], np.int64), np.array([wholes.get(x, -1) for x in r["cq"]], np.int64)
        self.cq, self.lengths = r["cq"], np.array([len(x) for x in r["cq"]], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.tokenless = bool(np.any((self.cq_at >= 0) & (self.size_of == 0)))
        # a text has a phrase only if it has its letters and digits, should there be any
        self.phrases, of = list(phrases), np.empty(len(phrases), np.int64)
        of[self.q_at] = self.cq_at
        self.by_whole, self.wholes_of = np.argsort(of, kind="stable"), np.sort(of)
        self.find_whole, self.find_marks = self._automaton(wholes), self._automaton({self.phrases[at]: int(at) for at in np.flatnonzero(of < 0)})
        limits = [r.get(c, [None] * size) for c in ("types", "first_page", "last_page")]
        told: dict[tuple, tuple] = {}
        keys = [told.get(x) or told.setdefault(x, (kinds_of(x[0]), *x[1:])) for x in zip([t if t is None else tuple(t) for t in limits[0]], *limits[1:], strict=True)]
        limits_at = number(keys)
        self.limit_keys, self.limit_at = list(limits_at), np.array([limits_at[x] for x in keys], np.int64)
        only = np.array(["FORMULA" in (t or ()) for t in limits[0]], bool)
        self.only = only & (self.words["q_formulas"].sizes > 0)
        self._groups(requests)
        self.best: list[list[tuple]] = [[] for _ in self.group_tokens]
        self.own: list[pa.Table] = []
        self._open()

    def _groups(self, requests: pa.Table) -> None:
        """The groups with their tokens and the group of each request; which tokens of a request are its own."""
        group = requests.column("group").combine_chunks()
        in_any = group.is_valid().to_numpy(zero_copy_only=False)
        self.group_id, first, which = np.unique(pc.fill_null(group, 0).to_numpy()[in_any], return_index=True, return_inverse=True)
        self.group_of = np.full(len(self.req), -1, np.int64)
        self.group_of[in_any] = which
        self.group_first = np.flatnonzero(in_any)[first]
        words, shared = self.words["tokens"], requests.column("shared").combine_chunks()
        keys, owners = _pairs(shared, words.words, 0)
        n = max(len(words.words), 1)
        self.own_token = ~among(np.unique(owners * n + keys), words.owners * n + words.at)
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
        low, high = np.searchsorted(owners, self.group_first), np.searchsorted(owners, self.group_first, "right")
        self.group_tokens = [keys[a:b].tolist() for a, b in zip(low, high, strict=True)]

    @staticmethod
    def _automaton(texts: dict[str, int]):
        automaton = ahocorasick.Automaton()
        for text, i in texts.items():
            automaton.add_word(text, i)
        automaton.make_automaton()
        return automaton if texts else None

    def _open(self) -> None:
        self.n = self.size = 0
        self.heads: list[pa.Table] = []
        self.found = {c: ([], []) for c in ("text", "section", "formulas", "figures", "phrase", "whole", "whole_section")}
        self.sides: dict[str, list[tuple[str, int, bool]]] = {"text": [], "section": []}

    def _add(self, what: str, keys, rows) -> None:
        self.found[what][0].append(np.array(keys, np.int64))
        self.found[what][1].append(np.array(rows, np.int64))

    def _search(self, t: list[str | None], ct: list[str | None], cs: list[str | None]) -> None:
        """The phrases and whole requests that the texts have."""
        pairs = {c: ([], []) for c in ("phrase", "whole", "whole_section")}

        def put(what: str, key: int, row: int) -> None:
            pairs[what][0].append(key)
            pairs[what][1].append(row)

        for row, whole in enumerate(ct if self.find_whole else (), self.n):
            for key in {i for _, i in self.find_whole.iter(whole)} if whole else ():
                put("whole", key, row)
                text = t[row - self.n] or ""
                for at in self.by_whole[np.searchsorted(self.wholes_of, key) : np.searchsorted(self.wholes_of, key, "right")].tolist():
                    if self.phrases[at] in text:
                        put("phrase", at, row)
        for row, section in enumerate(cs if self.find_whole else (), self.n):
            for key in {i for _, i in self.find_whole.iter(section)} if section else ():
                put("whole_section", key, row)
        for row, text in enumerate(t if self.find_marks else (), self.n):
            for key in {i for _, i in self.find_marks.iter(text)} if text else ():
                put("phrase", key, row)
        for what, own in pairs.items():
            self._add(what, *own)

    def feed(self, batch: pa.RecordBatch) -> None:
        for start in range(0, batch.num_rows, ROWS // 4):
            self._feed(batch.slice(start, ROWS // 4))
            if self.n >= ROWS or self.size >= PAIRS:
                self.close()

    def _feed(self, batch: pa.RecordBatch) -> None:
        ct, cs = batch.column("ct").to_pylist(), batch.column("cs").to_pylist()
        self._search(batch.column("t").to_pylist(), ct, cs)
        for what, column, texts in (("text", "t_tokens", ct), ("section", "s_tokens", cs)):
            own = batch.column(column)
            keys, rows = _pairs(own, self.words["tokens"].words, self.n, np.array([not x for x in texts], bool))
            self._add(what, keys, rows)
            self.size += len(keys)
            bare = (pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False) == 0).tolist()
            self.sides[what] += [(x[: self.longest], row, b) for row, (x, b) in enumerate(zip(texts, bare, strict=True), self.n) if x and (b or self.tokenless)]
        for what in ("formulas", "figures"):
            self._add(what, *_pairs(batch.column(what), self.words[f"q_{what}"].words, self.n))
        self.heads.append(pa.table({c: batch.column(c) for c in ("source_id", "page", "kind")}))
        self.n += batch.num_rows

    def close(self) -> None:
        """Compare the chunk with all requests."""
        if not self.n:
            return
        head = pa.concat_tables(self.heads)
        order = pc.sort_indices(head, sort_keys=[("page", "ascending"), ("source_id", "ascending")], null_placement="at_end")
        head, place = head.take(order), np.empty(self.n, np.int64)
        place[order.to_numpy()] = np.arange(self.n)
        self.head = head.select(["source_id", "page"]).combine_chunks()
        kinds = head.column("kind").combine_chunks().dictionary_encode()
        self.kinds, self.kind_at = kinds.dictionary.to_pylist(), pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
        self.page_at = pc.cast(head.column("page"), pa.float64()).to_numpy()  # none: nan
        self.masks: dict[int, np.ndarray] = {}
        self.lists = {what: Lists(*pairs, place) for what, pairs in self.found.items()}
        self.counts = {what: Counts(self.lists[what], self.n) for what in ("text", "section")}
        self.begun = {(what, all_of): Beginnings([(x, row) for x, row, bare in sides if all_of or bare], place) for what, sides in self.sides.items() for all_of in ((False, True) if self.tokenless else (False,))}
        for g in range(len(self.group_tokens)):
            self._group(g)
        self._own()
        self._open()

    def _mask(self, key: int, types: tuple | None, first: int | None, last: int | None) -> np.ndarray | None:
        """Which rows limits allow; none: all."""
        if types is None and first is None and last is None:
            return None
        if (mask := self.masks.get(key)) is None:
            mask = np.ones(self.n, bool)
            if types is not None:
                mask &= np.isin(self.kind_at, [k for k, kind in enumerate(self.kinds) if kind in types])
            if first is not None:
                mask &= ~(self.page_at < first)
            if last is not None:
                mask &= ~(self.page_at > last)
            if len(self.masks) < 256:
                self.masks[key] = mask
        return mask

    def _group(self, g: int) -> None:
        """The k best rows by the tokens that a group shares."""
        i, k, best, tokens = self.group_first[g], self.k, self.best[g], self.group_tokens[g]
        size, limit = int(self.size_of[i]), int(self.limit_at[i])
        need = best[-1][0] if len(best) == k else 0.0  # scores below minus this can't enter
        counts, there = self.counts["text"](tokens), self.counts["section"](tokens)
        if (allowed := self._mask(limit, *self.limit_keys[limit])) is not None:
            for own in (counts, there):
                if own is not None:
                    own *= allowed
        most = [0 if own is None else int(own.max()) for own in (counts, there)]
        taken: dict[int, float] = {}
        for score, by_section, v in levels(size):
            if v > most[by_section]:
                continue
            if -score > need or len(taken) >= k and score < self._last(taken):
                break
            at = np.flatnonzero((there if by_section else counts) == v)
            for row in at[: k + len(taken)].tolist():
                taken.setdefault(row, score)
        if taken:
            rows = list(taken)
            ids, pages = (self.head.column(c).take(pa.array(rows)).to_pylist() for c in ("source_id", "page"))
            bits = [(LEXICAL if counts is not None and counts[row] else 0) | (SECTION if there is not None and there[row] else 0) for row in rows]
            new = [(-taken[row], float("inf") if p is None else p, x, b) for row, p, x, b in zip(rows, pages, ids, bits, strict=True)]
            self.best[g] = sorted(best + new, key=lambda x: x[:3])[:k]

    @staticmethod
    def _last(taken: dict[int, float]) -> float:
        """The score of the latest row, the lowest of all."""
        return next(reversed(taken.values()))

    def _own(self) -> None:
        """The requests' own rows: spans of rows in lists, expanded for so many requests at a time."""
        words, spans = self.words["tokens"], []  # (requests, first places, numbers of rows)
        rows, at = [], 0

        def put(requests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
            some = lengths > 0
            spans.append((requests[some], starts[some] + at, lengths[some]))

        with_letters = self.cq_at[words.owners] >= 0
        for what, keys, owners in (
            *[(what, words.at[self.own_token & with_letters], words.owners[self.own_token & with_letters]) for what in ("text", "section")],
            *[(what, self.cq_at[self.cq_at >= 0], np.flatnonzero(self.cq_at >= 0)) for what in ("whole", "whole_section")],
            ("phrase", self.q_at, np.arange(len(self.req))),
            *[(what, self.words[f"q_{what}"].at, self.words[f"q_{what}"].owners) for what in ("formulas", "figures")],
        ):
            put(owners, *self.lists[what].spans(keys))
            rows.append(self.lists[what].rows)
            at += len(rows[-1])
        shares = {"text": ([], [], []), "section": ([], [], [])}  # (requests, rows, lengths) of common beginnings
        firsts = {key: {x[:1] for x in b.texts} for key, b in self.begun.items()}
        for i in range(len(self.req)) if any(firsts.values()) else ():
            for what in ("text", "section") if self.cq[i] else ():
                key = (what, not self.size_of[i])
                if self.cq[i][0] in firsts[key]:
                    own, n = self.begun[key](self.cq[i])
                    if len(own):
                        for x, y in zip(shares[what], (np.full(len(own), i), own, n), strict=True):
                            x.append(y)
                        put(np.array([i]), np.zeros(1, np.int64), np.array([len(own)]))
                        rows.append(own)
                        at += len(own)
        begun = {}
        for what, (own, r, n) in shares.items():
            keys = np.concatenate(own) * self.n + np.concatenate(r) if own else NONE
            order = np.argsort(keys)
            begun[what] = (keys[order], np.concatenate(n)[order] if own else NONE)
        owners, starts, lengths = (np.concatenate(x) for x in zip(*spans, strict=True))
        if not len(owners):
            return
        rows = np.concatenate(rows)
        order = np.argsort(owners, kind="stable")
        owners, starts, lengths = owners[order], starts[order], lengths[order]
        ends = np.cumsum(lengths)
        low = 0
        while low < len(owners):
            high = int(np.searchsorted(ends, ends[low] - lengths[low] + EXPANDED, "right"))
            high = int(np.searchsorted(owners, owners[min(max(high, low + 1), len(owners)) - 1], "right"))  # whole requests
            some = slice(low, high)
            both = np.unique(np.repeat(owners[some], lengths[some]) * self.n + rows[expanded(starts[some], lengths[some])])
            self._score(both // self.n, both % self.n, begun)
            low = high
        if sum(x.num_rows for x in self.own) > EXPANDED:
            self.own = [self._kept()]

    def _score(self, own: np.ndarray, rows: np.ndarray, begun: dict) -> None:
        """Keep the best k of each request among pairs of a request and a row, if they can be among its k best."""
        ok = np.ones(len(own), bool)
        order = np.argsort(self.limit_at[own], kind="stable")
        keys, firsts = np.unique(self.limit_at[own[order]], return_index=True)
        for key, some in zip(keys.tolist(), np.split(order, firsts[1:]), strict=True):
            if (mask := self._mask(key, *self.limit_keys[key])) is not None:
                ok[some] = mask[rows[some]]
        own, rows = own[ok], rows[ok]
        has = {what: self.lists[what].have(keys[own], rows) for what, keys in (("phrase", self.q_at), ("whole", self.cq_at), ("whole_section", self.cq_at))}
        has |= {what: self.words[f"q_{what}"].count(self.lists[what], own, rows) > 0 for what in ("formulas", "figures")}
        shares = {}
        for what, whole in (("text", "whole"), ("section", "whole_section")):
            share = self.words["tokens"].count(self.lists[what], own, rows) / np.maximum(self.size_of[own], 1)
            share[self.cq_at[own] < 0] = 0.0
            keys, n = begun[what]
            if len(keys):
                pairs = own * self.n + rows
                some = np.flatnonzero(among(keys, pairs))
                share[some] = np.maximum(share[some], np.minimum(1.0, n[np.searchsorted(keys, pairs[some])] / np.maximum(4, self.lengths[own[some]])))
            shares[what] = np.where(has[whole], 1.0, share)
        lexical, section = shares["text"], shares["section"]
        score = np.maximum(lexical * 0.72, np.where(section > 0, 0.35 + 0.55 * section, 0.0))
        score = np.maximum(score, np.where(has["phrase"], 0.96, 0.0))
        score = np.minimum(np.where(has["formulas"] | has["figures"], np.maximum(score, 1.0), score), 1.0)
        values, which = np.unique(score, return_inverse=True)
        score = np.array([rounded(x) for x in values.tolist()])[which] if len(values) else score
        bits = np.where(has["phrase"], PHRASE, np.where(lexical > 0, LEXICAL, 0)) + FORMULA * has["formulas"] + FIGURE * has["figures"] + np.where(section > 0, SECTION, 0)
        least = np.array([-x[-1][0] if len(x) == self.k else 0.0 for x in self.best] + [0.0])[self.group_of[own]]
        at = np.flatnonzero((score > 0) & (score >= least) & (~self.only[own] | has["formulas"]))
        at = at[np.lexsort((rows[at], -score[at], own[at]))]
        _, first, size = np.unique(own[at], return_index=True, return_counts=True)
        at = at[np.arange(len(at)) - np.repeat(first, size) < self.k]
        if len(at):
            head = self.head.take(pa.array(rows[at]))
            self.own.append(pa.table({"own": own[at], "neg": -score[at], "page": head.column("page"), "source_id": head.column("source_id"), "routes": bits[at].astype(np.int32)}))

    def _kept(self) -> pa.Table:
        """The best k of each request's own rows."""
        all_of = pa.concat_tables(self.own)
        all_of = all_of.take(pc.sort_indices(all_of, sort_keys=[(c, "ascending") for c in ("own", "neg", "page", "source_id")], null_placement="at_end"))
        _, first, size = np.unique(all_of.column("own").to_numpy(), return_index=True, return_counts=True)
        return all_of.filter(pa.array(np.arange(all_of.num_rows) - np.repeat(first, size) < self.k))

    def lists_of(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """(req, own, hits): the best of every group, under its first request, and of each request's own rows."""
        self.close()
        hit = schema.field("hits").type.value_type

        def made(reqs: np.ndarray, own: bool, sizes: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
            values = pa.StructArray.from_arrays([x.cast(hit.field(i).type) for i, x in enumerate(columns)], fields=[hit.field(i) for i in range(hit.num_fields)])
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array(reqs, pa.int64()), pa.array(np.full(len(reqs), own)), hits.cast(schema.field("hits").type)], schema=schema)

        for start in range(0, len(self.best), 4096):
            some = [g for g in range(start, min(start + 4096, len(self.best))) if self.best[g]]
            if flat := [x for g in some for x in self.best[g]]:
                neg, page, source, bits = zip(*flat, strict=True)
                late = [p == float("inf") for p in page]
                columns = [pa.array(neg), pa.array(late), pa.array([None if x else p for x, p in zip(late, page, strict=True)], hit.field("page").type), pa.array(source, hit.field("source_id").type), pa.array(bits)]
                yield made(self.group_id[some], False, np.array([len(self.best[g]) for g in some]), columns)
        if self.own:
            t = self._kept().combine_chunks()
            own, first, size = np.unique(t.column("own").to_numpy(), return_index=True, return_counts=True)
            columns = [t.column(c).combine_chunks() for c in ("neg", "page", "source_id", "routes")]
            columns.insert(1, columns[1].is_null())
            for start in range(0, len(own), 4096):
                a, n = first[start], size[start : start + 4096]
                yield made(self.req[own[start : start + 4096]], True, n, [x.slice(a, int(n.sum())) for x in columns])

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """(req, source_id, page, score, routes) of the k best of each request, its own and its group's."""
        self.close()
        own: list[list[tuple]] = [[] for _ in self.req]
        for x in self._kept().to_pylist() if self.own else ():
            own[x["own"]].append((x["neg"], float("inf") if x["page"] is None else x["page"], x["source_id"], x["routes"]))
        for i, (req, g) in enumerate(zip(self.req.tolist(), self.group_of.tolist(), strict=True)):
            known = {x[2] for x in own[i]}
            best = sorted(own[i] + [x for x in (self.best[g] if g >= 0 else ()) if x[2] not in known], key=lambda x: x[:3])[: self.k]
            if best:
                score, page, source, bits = zip(*best, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(([req] * len(best), source, [None if p == float("inf") else p for p in page], [-x for x in score], bits), schema, strict=True)], schema=schema)


def finder(block: bytes, k: int, schema: pa.Schema):
    """An Arrow function over sources for a block of requests, which is a serialized table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            if matcher is None:
                matcher = Matcher(pa.ipc.open_stream(block).read_all(), k)
            matcher.feed(batch)
        if matcher is not None:
            yield from matcher.lists_of(schema)

    return run
