"""Variant spellings of names typed by people, by noisy-channel attribution.

Distinct spellings are reduced to forms (case, accents, titles and marks folded), each a few readings of which part is
which. Frequent forms are candidate canonical ones. A form is compared only with the candidates that share a blocking
key with it, never with all others; each comparison gives the likelihood that the candidate was meant and this form
typed (typos, initials, nicknames, abbreviations, acronyms, reordering). Frequency prior times likelihood is the
posterior; each form is attached to its maximum, unless it is more probably a name of its own or no candidate holds
half of the posterior. Chains of attachments are followed to their roots, which are the entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.conversations import resolve_pointers
from paperloom.staging import stage

# ---- Fixed values: the channel --------------------------------------------------------------------------------------
#: Likelihoods of one typo, an initial, a listed or a learned nickname, surname first without a comma, a middle name
#: left out, a word abbreviated, an acronym, an umlaut written with e.
TYPO, INITIAL, NICKNAME, SWAPPED, MIDDLE, SHORTENED, ACRONYM, UMLAUT = 0.02, 0.2, 0.1, 0.05, 0.5, 0.3, 0.05, 0.3
#: Likelihood that a name within reach of a more frequent one is a name of its own.
OWN = 1e-4
#: Letters of a surname and a given name that may have a typo; in shorter ones most changes give another name.
SURNAME, GIVEN = 3, 3
#: Share of the posterior that the maximum must hold.
SHARE = 0.5
#: A nickname is learned from this many surnames, and this share of those it has.
LEARN_SURNAMES, LEARN_SHARE = 3, 0.6
#: An unlisted short form: begins like the full name, has at most this many letters, and is this many times rarer.
BEGINS, SHORT_LETTERS, RARER, UNLISTED = 2, 6, 20, 0.01
#: Titles, suffixes, and letters that have no decomposition.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "sir", "dame"}
SUFFIXES = {"jr", "sr", "ii", "iii", "phd", "md", "esq"}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "'": "", "’": "", "ʼ": ""})
#: Words that belong to the surname although a comma may part them from it.
PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "do", "del", "della", "la", "le", "du", "dos", "das", "ter", "ten", "zu", "zur", "af", "av", "bin", "ibn", "al", "el"}
#: Words that venues are written with or without.
FILLERS = {"of", "on", "in", "for", "and", "the", "to", "at", "a", "an"}


def folded(text: str) -> str:
    """Lower case without accents, ß and ss as one s."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ss", "s")


def distance_one(a: str, b: str) -> bool:
    """Whether a and b differ by at most one insertion, deletion, replacement or exchange of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def deletions(word: str, least: int) -> set[str]:
    """The word and, if it has ``least`` letters, what one deletion makes of it; two words at distance one share one."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= least else set())


# ---- people ---------------------------------------------------------------------------------------------------------
@lru_cache(1 << 16)
def author_readings(name: str) -> list[tuple[str, str, str, float]]:
    """(given, middle initials, surname, weight) as the entry may be meant, the plainest first; none for one word."""
    out = _plain_readings(name)
    # ä, ö and ü written ae, oe and ue
    return out + [(g, m, bare, w * UMLAUT) for g, m, s, w in out if (bare := re.sub(r"(?<=[aou])e", "", s)) != s]


def _plain_readings(name: str) -> list[tuple[str, str, str, float]]:
    head, comma, tail = folded(name).partition(",")
    words = lambda s: re.findall(r"[^\W\d_]+", s)
    before, after = words(head), words(tail)
    while len(before) + len(after) > 2 and before and before[0] in TITLES:
        before = before[1:]
    while len(before) + len(after) > 2 and (after or before)[-1] in SUFFIXES:
        (after or before).pop()
    k = len(after)
    while k > 1 and after[k - 1] in PARTICLES:
        k -= 1
    before, after = after[k:] + before, after[:k]
    if comma and before and after:
        return [(after[0], "".join(x[0] for x in after[1:]), "".join(before), 1.0)]
    t = before + after
    if len(t) < 2:
        return []
    if len(t[-1]) == 1 and len(t[0]) > 1:  # initials last
        k = len(t)
        while k > 1 and len(t[k - 1]) == 1:
            k -= 1
        return [(t[k], "".join(t[k + 1 :]), "".join(t[:k]), 1.0)]
    k = 1
    while k < len(t) - 1 and len(t[k]) == 1:
        k += 1
    out = [(t[0], "".join(t[1:k]), "".join(t[k:]), 1.0)]
    if len(t) > 2 and k == 1:
        out.append((t[0], t[1][0], "".join(t[2:]), MIDDLE * TYPO))
    if len(t[0]) > 1:
        out.append((t[-1], "", "".join(t[:-1]), SWAPPED))
    return out


def author_keys(readings: list[tuple], nicknames: dict[str, set[str]]) -> tuple[set[str], set[str]]:
    """Blocking keys (as a variant, as a candidate) of a form."""
    variant, candidate = set(), set()
    for no, (given, _, surname, _) in enumerate(readings):
        near = deletions(surname, SURNAME)
        if len(given) == 1:
            variant |= {f"@{x}|{given}" for x in near}
            continue
        own = {f"a{x}|{given}" for x in near} | {f"b{surname}|{y}" for y in deletions(given, GIVEN)}
        variant |= own | {f"a{x}|{g}" for g in nicknames.get(given, ()) for x in near}
        if 3 <= len(given) <= SHORT_LETTERS:
            variant.add(f"n{surname}|{given[:BEGINS]}")
        if no == 0 and len(given) > 3:
            candidate.add(f"n{surname}|{given[:BEGINS]}")
        if no == 0:
            candidate |= own | {f"@{x}|{given[0]}" for x in near}
    return variant, candidate


def author_likelihood(variant: list[tuple], candidate: tuple, nicknames: dict[str, set[str]], rarer: bool = False) -> tuple[float, bool]:
    """(how likely the variant's best reading is if the candidate's plainest was meant, whether by a nickname); 0 if it
    can't be. ``rarer``: the variant's given name is ``RARER`` times rarer than the candidate's."""
    best = (0.0, False)
    given, middle, surname, _ = candidate
    for g, m, s, weight in variant:
        by_nickname = False
        if s != surname:
            if min(len(s), len(surname)) < SURNAME or not distance_one(s, surname):
                continue
            weight *= TYPO
        if g != given:
            if len(g) == 1 or len(given) == 1:
                if len(g) > 1 or g != given[0]:
                    continue
                weight *= INITIAL
            elif given in nicknames.get(g, ()):
                weight *= NICKNAME
                by_nickname = True
            elif min(len(g), len(given)) >= GIVEN and distance_one(g, given):
                weight *= TYPO
            elif rarer and s == surname and 3 <= len(g) <= SHORT_LETTERS and len(g) < len(given) and g[:BEGINS] == given[:BEGINS]:
                weight *= UNLISTED
                by_nickname = True
            else:
                continue
        if m != middle:
            if m and middle and not (m.startswith(middle) or middle.startswith(m)):
                continue
            weight *= MIDDLE
        best = max(best, (weight, by_nickname))
    return best


# ---- venues ---------------------------------------------------------------------------------------------------------
@lru_cache(1 << 16)
def venue_words(name: str) -> list[str]:
    """The words of a venue: fillers left out, a part after the last comma first, no acronym in brackets at the end and
    no "Proceedings of" before another word that says what it is."""
    text = re.sub(r"\s*[(\[][^()\[\]]*[)\]]\s*\.?$", "", folded(name)) or folded(name)
    head, comma, tail = text.rpartition(",")
    if comma and head.strip() and tail.strip():
        text = tail + " " + head
    words = [w for w in re.findall(r"[^\W_]+", text) if w not in FILLERS]
    if len(words) > 3 and (words[0] == "proc" or distance_one(words[0], "procedings") or words[0] == "proceedings"):
        words = words[1:]
    return words


def venue_keys(words: list[str]) -> tuple[set[str], set[str]]:
    """Blocking keys (as a variant, as a candidate): initials, also with any one of them open for a typo."""
    if len(words) < 2:
        return ({f"v{words[0]}"} if words and len(words[0]) >= 3 else set()), set()
    initials = "".join(w[0] for w in words)
    open_ = {f"w{initials[:i]}_{initials[i + 1 :]}" for i in range(len(initials))}
    return open_, open_ | {f"v{initials}"}


def shortens(short: str, word: str) -> bool:
    """Whether a word may be abbreviated so: its beginning, or its first letter and some others in order."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    rest = iter(word)
    return len(short) >= 2 and len(short) <= len(word) - 2 and all(c in rest for c in short)


def venue_likelihood(variant: list[str], candidate: list[str]) -> tuple[float, bool]:
    """(likelihood, whether abbreviated) of a venue's words if the candidate's were meant."""
    if len(variant) == 1 and len(candidate) > 2:
        return (ACRONYM, True) if variant[0] == "".join(w[0] for w in candidate) else (0.0, True)
    if len(variant) != len(candidate):
        return 0.0, False
    weight, short, typos = 1.0, False, 0
    for a, b in zip(variant, candidate):
        if a == b:
            continue
        if min(len(a), len(b)) >= 4 and distance_one(a, b):
            weight *= TYPO
            typos += 1
        elif shortens(a, b):
            weight *= SHORTENED
            short = True
        else:
            return 0.0, short
    return (weight if typos < 2 else 0.0), short


# ---- the operator ---------------------------------------------------------------------------------------------------
def author_entries(papers: DataFrame, column: str = "authors") -> DataFrame:
    """(name) of every entry: parted by semicolons when the row has any, else by commas, "and" and "&"; no spaces at
    the ends, no empty entries."""
    by = F.when(F.col(column).contains(";"), F.split(column, ";")).otherwise(F.split(column, r"[,&]|(?<![\p{L}\p{M}\p{N}_])and(?![\p{L}\p{M}\p{N}_])"))
    return papers.select(F.explode(by).alias("name")).select(F.regexp_replace("name", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("name")).filter("name != ''")


def _forms(spellings: DataFrame) -> DataFrame:
    """(kind, name, n, form): a form is the plainest reading; names that have none stand for themselves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            forms = []
            for kind, name in zip(pdf["kind"], pdf["name"]):
                if kind == "author":
                    readings = author_readings(name)
                    forms.append("|".join(readings[0][:3]) if readings else "=" + name)
                else:
                    words = venue_words(name)
                    forms.append(" ".join(words) if words else "=" + name)
            yield pdf.assign(form=forms)

    return spellings.mapInPandas(run, "kind string, name string, n bigint, form string")


def _nicknames(fulls: list[str] | None) -> dict[str, set[str]]:
    """Short forms with what they stand for, from texts "short\\tfull"."""
    out: dict[str, set[str]] = {}
    for entry in fulls if fulls is not None else ():
        short, _, full = entry.partition("\t")
        out.setdefault(short, set()).add(full)
    return out


def _with_nicknames(forms: DataFrame, nicknames: DataFrame) -> DataFrame:
    """The forms with ``fulls``, what the given names of their readings may stand for: texts "short\\tfull", or null.

    ``nicknames`` has short and full, folded. Names are joined, so neither the driver nor a task holds them all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(form, g) for kind, form, sample in zip(pdf["kind"], pdf["form"], pdf["sample"]) if kind == "author" and not form.startswith("=") for g in {r[0] for r in author_readings(sample)}]
            yield pd.DataFrame(rows, columns=["form", "short"])

    meant = forms.select("kind", "form", "sample").mapInPandas(run, "form string, short string").join(nicknames, "short")
    meant = meant.groupBy("form").agg(F.collect_set(F.concat_ws("\t", "short", "full")).alias("fulls")).withColumn("kind", F.lit("author"))
    return forms.join(meant, ["kind", "form"], "left")


def _keyed(forms: DataFrame) -> DataFrame:
    """(kind, form, n, sample, fulls, total, side, key): every blocking key of every form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for kind, form, n, sample, fulls, total in pdf[["kind", "form", "n", "sample", "fulls", "total"]].itertuples(index=False):
                if form.startswith("="):
                    continue
                sides = author_keys(author_readings(sample), _nicknames(fulls)) if kind == "author" else venue_keys(venue_words(sample))
                rows += [(kind, form, n, sample, fulls, total, side, key) for side, keys in enumerate(sides) for key in keys]
            yield pd.DataFrame(rows, columns=["kind", "form", "n", "sample", "fulls", "total", "side", "key"])

    return forms.mapInPandas(run, "kind string, form string, n bigint, sample string, fulls array<string>, total bigint, side int, key string")


def _scored(pairs: DataFrame) -> DataFrame:
    """(kind, form, n, target, m, likelihood, short, directed): the pairs whose likelihood isn't 0. ``short``: initials,
    abbreviations and acronyms; ``directed``: a nickname, which points to the full name however frequent either is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for kind, form, n, sample, fulls, target, m, other, rarer in pdf[["kind", "form", "n", "sample", "fulls", "target", "m", "other", "rarer"]].itertuples(index=False):
                if kind == "author":
                    readings = author_readings(sample)
                    (likelihood, directed), short = author_likelihood(readings, author_readings(other)[0], _nicknames(fulls), rarer), len(readings[0][0]) == 1
                else:
                    (likelihood, short), directed = venue_likelihood(venue_words(sample), venue_words(other)), False
                if likelihood > 0:
                    rows.append((kind, form, n, target, m, likelihood, short, directed))
            yield pd.DataFrame(rows, columns=["kind", "form", "n", "target", "m", "likelihood", "short", "directed"])

    return pairs.mapInPandas(run, "kind string, form string, n bigint, target string, m bigint, likelihood double, short boolean, directed boolean")


def learned_nicknames(forms: DataFrame) -> DataFrame:
    """(short, full): given names that stand beside a more frequent one under most of their surnames.

    All surnames teach. A full name must stand beside the short one under ``LEARN_SHARE`` of its surnames, so under at
    least one of any few more than the rest: pairs are looked for under that many of the short name's narrowest
    surnames, which loses none and spares the surnames that everybody has, and are then counted under all.
    """
    parts = F.split("form", r"\|")
    people = forms.filter((F.col("kind") == "author") & ~F.col("form").startswith("=")).select(parts[0].alias("g"), parts[2].alias("s"), "n").filter("length(g) > 2")
    people = people.groupBy("g", "s").agg(F.sum("n").alias("n"))
    all_of = people.groupBy("g").agg(F.count("*").alias("surnames"), F.sum("n").alias("total")).filter("surnames >= 2")
    known = stage(people.join(all_of, "g"))
    wide = known.groupBy("s").agg(F.count("*").alias("width"))
    narrow = Window.partitionBy("g").orderBy("width", "s")
    enough = F.col("surnames") - F.ceil(F.col("surnames") * LEARN_SHARE) + 1
    probes = known.join(wide, "s").withColumn("r", F.row_number().over(narrow)).filter(F.col("r") <= enough)
    other = known.select("s", F.col("g").alias("full"), F.col("n").alias("m"), F.col("total").alias("full_total"))
    fits = (F.col("m") > F.col("n")) & (F.col("total") * RARER < F.col("full_total") * 4)
    found = probes.join(other, "s").filter(fits).select("g", "full").distinct()
    pairs = found.join(known, "g").join(other.drop("full_total"), ["s", "full"]).filter(F.col("m") > F.col("n"))
    seen = pairs.groupBy("g", "full", "surnames").agg(F.count("*").alias("together"))
    often = (F.col("together") >= LEARN_SURNAMES) & (F.col("together") >= LEARN_SHARE * F.col("surnames"))
    alike = (F.col("together") == F.col("surnames")) & (F.col("together") >= 2) & (F.substring("g", 1, 1) == F.substring("full", 1, 1))
    return seen.filter(often | alike).select(F.col("g").alias("short"), "full")


def entities(spellings: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(kind, name, entity): the entity of every distinct spelling.

    ``spellings`` has kind (``author`` or ``source``), name and n, its frequency; null names and empty ones must be
    left out. ``name_forms`` has short_form and full_form of given names.
    """
    own = stage(_forms(spellings))
    forms = stage(own.groupBy("kind", "form").agg(F.sum("n").alias("n"), F.max_by("name", F.struct("n", "name")).alias("sample")))
    fold = F.pandas_udf(lambda names: names.map(folded), "string")
    listed = name_forms.filter("short_form is not null and full_form is not null").select(fold("short_form").alias("short"), fold("full_form").alias("full"))
    nicknames = listed.unionByName(learned_nicknames(forms)).distinct()
    # how often each given name occurs, whoever has it
    given = F.when((F.col("kind") == "author") & ~F.col("form").startswith("="), F.substring_index("form", "|", 1))
    named = forms.withColumn("given", given)
    totals = named.filter("given is not null").groupBy("given").agg(F.sum("n").alias("total"))
    keyed = stage(_keyed(_with_nicknames(named.join(totals, "given", "left").drop("given"), nicknames)))
    candidates = keyed.filter("side = 1").select("kind", "key", F.col("form").alias("target"), F.col("n").alias("m"), F.col("sample").alias("other"), F.col("total").alias("target_total"))
    rarer = F.coalesce(F.col("total") * RARER <= F.col("target_total"), F.lit(False))
    # candidates are ranked by frequency: a key of a full spelling leads to more frequent ones only, unless it can be
    # directed (nicknames, short forms); the keys of unlisted short forms lead to much more frequent given names only
    upward = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("target") < F.col("form")))
    free = F.col("key").startswith("@") | F.col("key").startswith("v") | F.col("key").startswith("w") | F.col("fulls").isNotNull()
    wanted = F.when((F.col("kind") == "author") & F.col("key").startswith("n"), rarer | upward).otherwise(free | upward)
    pairs = keyed.filter("side = 0").join(candidates, ["kind", "key"]).filter((F.col("form") != F.col("target")) & wanted).withColumn("rarer", rarer)
    # a pair may share several keys; the rows of one pair are alike but for the key
    pairs = pairs.drop("side", "key", "total", "target_total").dropDuplicates(["kind", "form", "target"])
    scored = stage(_scored(pairs))

    # first the forms written in full: typos, nicknames and reorderings point to more frequent forms
    best = Window.partitionBy("kind", "form").orderBy(F.desc("posterior"), F.asc("target"))
    ranked = scored.filter("not short").filter((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("target") < F.col("form"))) | F.col("directed"))
    ranked = ranked.withColumn("posterior", F.col("m") * F.col("likelihood")).filter(F.col("posterior") > F.col("n") * OWN)
    upward = ranked.withColumn("r", F.row_number().over(best)).filter("r = 1").select("kind", "form", "target")
    ident = lambda form: F.concat("kind", F.lit("\t"), form)
    nodes = forms.select(ident("form").alias("id"), "n").join(upward.select(ident("form").alias("id"), ident("target").alias("parent")), "id", "left")
    nodes = stage(nodes)
    roots = stage(resolve_pointers(nodes.select("id", "parent")).select("id", F.coalesce("root", "id").alias("root")))

    # then initials, abbreviations and acronyms, among the entities found so far
    weights = roots.join(nodes.select("id", "n"), "id").groupBy("root").agg(F.sum("n").alias("weight"))
    short = scored.filter("short").select(ident("form").alias("id"), ident("target").alias("target"), "likelihood")
    options = short.join(roots.select(F.col("id").alias("target"), "root"), "target").join(weights, "root")
    options = options.groupBy("id", "root").agg((F.max("likelihood") * F.first("weight")).alias("posterior"))
    mine = Window.partitionBy("id")
    chosen = (
        options.withColumn("share", F.col("posterior") / F.sum("posterior").over(mine))
        .withColumn("r", F.row_number().over(mine.orderBy(F.desc("posterior"), F.asc("root"))))
        .filter((F.col("r") == 1) & (F.col("share") >= SHARE))
        .select("id", F.col("root").alias("parent"))
    )
    # the root of an abbreviated form takes its whole class along
    moves = roots.join(chosen, "id").filter("root != parent").groupBy("root").agg(F.min_by("parent", "id").alias("parent"))
    tops = stage(roots.select("root").distinct().join(moves, "root", "left").filter(F.col("parent").isNull() | (F.col("parent") != F.col("root"))))
    final = resolve_pointers(tops.select(F.col("root").alias("id"), "parent")).select(F.col("id").alias("root"), F.coalesce("root", "id").alias("entity"))
    placed = roots.join(final, "root").select("id", "entity")
    return own.withColumn("id", ident("form")).join(placed, "id").select("kind", "name", "entity")


def name_spellings(papers: DataFrame) -> DataFrame:
    """(kind, name, n): the distinct spellings of authors and sources with their frequencies; null and blank ones are
    left out."""
    authors = author_entries(papers).withColumn("kind", F.lit("author"))
    sources = papers.select(F.col("source").alias("name"), F.lit("source").alias("kind")).filter(F.col("name").rlike(r"[^\s\p{Z}]"))
    return authors.unionByName(sources).groupBy("kind", "name").agg(F.count("*").alias("n"))


def spelling_pairs(papers: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) with name_a < name_b: the pairs of spellings of one entity. Needs authors and source;
    other columns are not read. Null, empty and blank entries give no row, nor does an empty table."""
    found = stage(entities(name_spellings(papers), name_forms))
    a = found.select("kind", "entity", F.col("name").alias("name_a"))
    b = found.select("kind", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "entity"]).filter("name_a < name_b").select("kind", "name_a", "name_b")
