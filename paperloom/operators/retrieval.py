"""Lexical retrieval of sources for needs: the best of every need by one pass over the sources, fair selection.

A need can score with every source that shares a token with it, which for a common token is a share of all: pairs grow as
the square of the input. So they never become rows: the needs go to the tasks in blocks of bounded size, each task keeps
the k best sources of every group of needs that share tokens and what of a need's own can be among its k best
(``ranking``), and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.functions import text as T
from paperloom.operators.ranking import FIGURE, FORMULA, LEXICAL, PHRASE, SECTION, finder, grouped
from paperloom.staging import stage, unstage

#: Characters of the needs of one automaton.
AUTOMATON = 4 << 20
#: Characters of the different needs of one pass over the sources, and the number of needs.
REQUESTS, MOST_REQUESTS = 10 << 20, 160_000


def _automata(needs: DataFrame) -> Iterator[list[str]]:
    """The distinct texts to look for, in blocks of at most ``AUTOMATON`` characters (or one text)."""
    block, size = [], 0
    for row in needs.toLocalIterator(prefetchPartitions=True):
        if block and size + len(row[0]) > AUTOMATON:
            yield block
            block, size = [], 0
        block.append(row[0])
        size += len(row[0])
    if block:
        yield block


def _finder(block: list[str], columns: list[str]):
    """An Arrow function over (source_id, page, kind, <columns>): which texts of the block each column has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text in block:
            automaton.add_word(text, text)
        automaton.make_automaton()
        for batch in batches:
            own, found, where = [], [], []
            for k in range(batch.num_rows):
                for name in columns:
                    text = batch.column(name)[k].as_py()
                    hits = {x for _, x in automaton.iter(text)} if text else ()
                    own += [k] * len(hits)
                    found += hits
                    where += [name] * len(hits)
            head = [batch.column(c).take(pa.array(own, pa.int64())) for c in ("source_id", "page", "kind")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(found, pa.string()), pa.array(where, pa.string())], names=["source_id", "page", "kind", "found", "place"])

    return run


def containing(texts: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """(source_id, page, kind, found, place): every text of ``texts`` (one column, distinct, not empty) that a source has
    in one of the columns, which is the place. The sources are read once for every block of texts."""
    kinds = dict(sources.dtypes)
    schema = f"source_id {kinds['source_id']}, page {kinds['page']}, kind string, found string, place string"
    out = sources.select("source_id", "page", "kind", F.lit("").alias("found"), F.lit("").alias("place")).filter("false")
    for block in _automata(texts):
        out = out.unionByName(sources.select("source_id", "page", "kind", *columns).mapInArrow(_finder(block, columns), schema))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], characters: int, most: int) -> Iterator[tuple[pa.Table, int]]:
    """Requests in tables of at most so many characters and rows (or of one row), with their characters."""
    held, size, rows = [], 0, 0
    for batch in batches:
        low = 0
        for at, (q, cq) in enumerate(zip(*(pc.utf8_length(batch.column(c)).to_pylist() for c in ("q", "cq")), strict=True)):
            if rows and (size + 2 * q + cq > characters or rows >= most):
                yield pa.Table.from_batches([*held, batch.slice(low, at - low)]), size
                held, size, rows, low = [], 0, 0, at
            size, rows = size + 2 * q + cq, rows + 1
        held.append(batch.slice(low))
    if rows:
        yield pa.Table.from_batches(held), size


def _serialized(table: pa.Table) -> bytes:
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _grouped(requests: DataFrame) -> DataFrame:
    """The requests with what they share with others (``ranking.grouped``), a block's worth at a time. No shuffle."""
    limits = REQUESTS, MOST_REQUESTS
    schema = StructType([*requests.schema, *StructType.fromDDL("shared array<string>, group bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _ in _pieces(batches, *limits):
            yield from grouped(piece).combine_chunks().to_batches()

    return requests.mapInArrow(run, schema)


def _request_blocks(requests: DataFrame) -> Iterator[bytes]:
    """The requests as serialized Arrow tables of at most ``REQUESTS`` characters and ``MOST_REQUESTS`` rows (or one), made
    by the tasks."""
    limits = REQUESTS, MOST_REQUESTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, size in _pieces(batches, *limits):
            yield pa.RecordBatch.from_pydict({"block": [_serialized(piece)], "n": [piece.num_rows], "size": [size]})

    held, n, size = [], 0, 0
    for row in requests.mapInArrow(run, "block binary, n bigint, size bigint").toLocalIterator(prefetchPartitions=True):
        if held and (n + row["n"] > limits[1] or size + row["size"] > limits[0]):
            yield _serialized(pa.concat_tables(held))
            held, n, size = [], 0, 0
        held.append(pa.ipc.open_stream(bytes(row["block"])).read_all())
        n, size = n + row["n"], size + row["size"]
    if held:
        yield _serialized(pa.concat_tables(held))


def prepared(sources: DataFrame) -> DataFrame:
    """Sources with all that ``search`` compares, to be staged where several searches read them."""
    s = sources.select("source_id", "page", "kind", T.unified(F.col("text")).alias("text"), T.unified(F.coalesce("section", F.lit(""))).alias("section"))
    s = s.withColumns({"t": F.lower(T.collapsed(F.concat_ws(" ", "text", "section"))), "cs": T.compact(F.col("section")), "s_tokens": T.tokens(F.col("section"))})
    numbers = lambda kind, pattern: F.when(F.col("kind") == kind, T.numbers_in(F.col("text"), pattern)).otherwise(F.array().cast("array<string>"))
    s = s.withColumns({"ct": T.compact(F.col("t")), "t_tokens": T.tokens(F.col("t")), "formulas": numbers("FORMULA", T.LABELS), "figures": numbers("FIGURE", T.FIGURES)})
    return s.drop("text", "section")


def search(needs: DataFrame, sources: DataFrame, k: int = 50) -> DataFrame:
    """The best ``k`` sources of every need: (need_id, source_id, score, routes, rank).

    needs: need_id, query and, if wanted, types (an array of kinds; an empty or null one allows all), first_page and
    last_page (null: open). sources: source_id, page, kind, text, section, or what ``prepared`` makes of them. 0.72 of the
    coverage of the need by the text and section; a phrase found as it stands gives 0.96; a formula or figure number that a
    source of that kind has gives 1; coverage c by the section alone gives 0.35 + 0.55 c. Coverage is that of
    ``text.coverage``. A need that names formulas and asks for that kind gets only those. The greatest score counts, at
    most 1; sources of score 0 are left out. Ties go to the lower page (none comes last), then the lower id. Blank needs find
    nothing. Compatibility forms are plain ones. source_id isn't null.
    """
    limits = [c for c in ("types", "first_page", "last_page") if c in needs.columns]
    n = needs.select("need_id", F.lower(T.collapsed(T.unified(F.col("query")))).alias("q"), *limits).filter("q != ''")
    n = stage(n)
    r = n.drop("need_id").dropDuplicates(["q", *limits])
    r = r.withColumns({"tokens": T.tokens(F.col("q")), "cq": T.compact(F.col("q")), "q_formulas": T.numbers_in(F.col("q"), T.FORMULAS), "q_figures": T.numbers_in(F.col("q"), T.FIGURES)})
    r = stage(_grouped(r.withColumn("req", F.monotonically_increasing_id())))
    ready = "t_tokens" in sources.columns
    s = sources if ready else prepared(sources)
    blocks, own = list(_request_blocks(r)), None
    if len(blocks) > 1 and not ready:
        s = own = stage(s)
    # every task reads a block's requests and gives k rows a group, so their number follows the cores, not the sources
    s = s.coalesce((1 if ready or own is not None else 4) * s.sparkSession.sparkContext.defaultParallelism)
    kinds = dict(s.dtypes)
    shape = StructType.fromDDL(f"req bigint, own boolean, hits array<struct<neg: double, late: boolean, page: {kinds['page']}, source_id: {kinds['source_id']}, routes: int>>")
    best = s.sparkSession.createDataFrame([], shape)
    for i, block in enumerate(blocks):
        found = s.mapInArrow(finder(block, k, to_arrow_schema(shape)), shape)
        best = best.unionByName(found) if i else found
    # a group may stand in two blocks
    best = best.groupBy("req", "own").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k).alias("hits"))
    best = stage(best)
    if own is not None:
        unstage(own)
    same = n.withColumnsRenamed({c: f"_{c}" for c in ["q", *limits]}).join(r.select("req", "group", "q", *limits), (F.col("_q") == F.col("q")) & reduce(and_, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in limits], F.lit(True)))
    scored = same.select("need_id", "req", "group").join(best.filter("own").select("req", F.col("hits").alias("_own")), "req", "left")
    scored = scored.join(best.filter("not own").select(F.col("req").alias("group"), F.col("hits").alias("_group")), "group", "left")
    mine, ours = (F.coalesce(c, F.array().cast(shape["hits"].dataType)) for c in ("_own", "_group"))
    # a request's own row stands for the same source of its group
    others = F.filter(ours, lambda x: ~F.array_contains(F.transform(mine, lambda y: y["source_id"]), x["source_id"]))
    scored = scored.select("need_id", F.posexplode(F.slice(F.array_sort(F.concat(mine, others)), 1, k)).alias("_no", "_h"))
    has = lambda bit: F.col("_h.routes").bitwiseAND(F.lit(bit)) > 0
    routes = F.array_join(F.array_compact(F.array(F.when(has(PHRASE), "EXACT_PHRASE").when(has(LEXICAL), "TOKEN_COVERAGE"), F.when(has(FORMULA), "FORMULA_NUMBER"), F.when(has(FIGURE), "FIGURE_NUMBER"), F.when(has(SECTION), "SECTION"))), "+")
    return scored.select("need_id", "_h.source_id", (-F.col("_h.neg")).alias("score"), routes.alias("routes"), (F.col("_no") + 1).alias("rank"))


def fair_selection(hits: DataFrame, group: str, need: str, source: str, rank: str, most: int) -> DataFrame:
    """At most ``most`` sources a group: every need's best first, then in order of need and rank, none twice.

    (group, source, place). ``hits`` has at most k rows a need, and a group a few needs.
    """
    w = Window.partitionBy(group).orderBy(F.when(F.col(rank) == 1, 0).otherwise(1), F.col(need), F.col(rank))
    first = hits.withColumn("_p", F.row_number().over(w)).groupBy(group, source).agg(F.min("_p").alias("_p"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_p")))
    return placed.filter(F.col("place") <= most).select(group, source, "place")


def fill_missing(needs: DataFrame, found: DataFrame, again: DataFrame, need: str) -> DataFrame:
    """``found`` with the rows of ``again`` for the needs that found nothing."""
    empty = needs.select(need).distinct().join(found.select(need).distinct(), need, "left_anti")
    return found.unionByName(again.join(empty, need, "left_semi"))


def target_state(targets: Column, texts: Column) -> tuple[Column, Column]:
    """(matched, missing): the targets that some text has, letters and digits compared, and the others."""
    has = lambda t: F.exists(texts, lambda x: F.contains(T.compact(x), T.compact(t)))
    return F.filter(targets, has), F.filter(targets, lambda t: ~has(t))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters of a text's letters and digits."""
    t = T.compact(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))


def claim_similarity(query: Column, claim: Column) -> Column:
    """0.65 of the share of the query's characters that a claim has and 0.35 of that of its character pairs."""
    q, c = T.compact(query), T.compact(claim)
    chars = lambda t: F.array_distinct(F.split(t, ""))
    one = F.size(F.array_intersect(chars(q), chars(c))) / F.size(chars(q))
    two = F.size(F.array_intersect(bigrams(query), bigrams(claim))) / F.size(bigrams(query))
    return F.when((q == "") | (c == ""), 0.0).otherwise(0.65 * one + 0.35 * two)


def number_citations(rows: DataFrame, group: str, position: Sequence[Column], source: str) -> DataFrame:
    """Sources numbered within their group by first appearance: (group, source, label) with labels S1, S2, ..."""
    first = rows.groupBy(group, source).agg(F.min(F.struct(*position)).alias("_p"))
    w = Window.partitionBy(group).orderBy("_p", source)
    return first.select(group, source, F.concat(F.lit("S"), F.row_number().over(w).cast("string")).alias("label"))


def request_fingerprint(*fields: Column) -> Column:
    """A hash of normalised fields: arrays sorted and without repeats, texts lower-case and collapsed."""
    return F.sha2(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)])), 256)


def fitting_length(text: Column, budget: int) -> Column:
    """The longest prefix length, shrunk by a quarter at a time, whose bytes fit a budget."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.floor(F.length(text) * F.pow(F.lit(0.75), i)).cast("int"))
    fits = F.filter(steps, lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= budget)
    return F.coalesce(F.array_max(fits), F.lit(0))
