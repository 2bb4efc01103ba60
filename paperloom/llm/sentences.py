"""Sentence boundaries in texts of any language or script, by a finite transducer.

First quotations and brackets are paired, whatever their depth or length. What stands outside of them is then read as
symbols: plain words, ends (each end mark, line break before a list item and space in Thai being judged by its
neighbourhood: abbreviation, initial, decimal, ordinal, what follows), numbers, blank lines, openers and closers. The
rules of how symbols make sentences are a table of four states by nine symbols: the next state, and whether a boundary
is put out.

A long document is cut into chunks between any two letters. Each chunk is judged apart and gives a function over all
states; functions are composed associatively, by prefix scan, which tells the state before each chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.staging import spread_of, stage

#: Characters on either side in which the neighbours of a list item's number are looked for.
SPAN = 1500
#: Characters of a chunk; longer documents are cut.
CHUNK = 1 << 15
#: Characters around a chunk by which its symbols are judged, more than any rule looks at besides white space.
REACH = 2048

# ---- Fixed values: marks -------------------------------------------------------------------------------------------
#: End marks that end a sentence whatever follows.
HARD = "。！？｡．؟۔।॥።፧։។၏။᠃᠉"
#: All end marks.
MARKS = HARD + ".!?…‼⁇⁈⁉"
#: Openers with what closes them.
PAIRS = {
    "“": "”", "„": "“”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "〖": "〗",
    "(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "｢": "｣", "〝": "〞〟", '"': '"', "＂": "＂",
}
BRACKETS = "([{（［｛【〔〖"
CLOSERS = "”’»›」』》〉】〕〗)]}）］｝｣〞〟\"＂'"
OPENERS = "".join(PAIRS) + "‘¿¡'"

# ---- Fixed values: abbreviations (lower case, without the last full stop) -------------------------------------------
#: Before a name, with a capital letter.
TITLES = set(
    """dr prof mr mrs ms mx messrs st sr sra srta sres dra drs mme mmes mlle mm hr hrn hrrn fr frl fa rev hon gen col capt lt sgt gov pres sen rep ing lic
    gral mag dipl ud uds dott sig sigg avv ee""".split()
)
#: Never at the end of a sentence.
NEVER = set(
    """dr prof sr sra dra cf vs vgl ca approx aprox env bzw sog gem resp viz ie eg i.e e.g z.b d.h u.a o.ä i.d p.ej p.ex c.-à-d ej c.-à
    esp incl excl проф доц акад им см ср напр т.е т.к ул г-н г-жа κ κα δρ καθ π.χ δηλ βλ डॉ प्रो श्री श्रीमती सुश्री
    ดร ผศ รศ นพ พญ น.ส นาย""".split()
)
#: Before a number or a letter that counts something; at the end only before other words if those are listed in MAY.
NUMBERED = set(
    """no nos nr nrn fig figs eq eqs eqn sec secs sect tab tbl app vol vols p pp ch chap chs ref refs ex exs art arts par para pt col ver v § abb kap bd s ss ziff
    núm núms pág págs ap apdo cap caps ec ecs secc lám n° nº num chapitre annexe éq рис табл гл прил стр с п разд т вып ч ур εικ πίν κεφ σελ αρ
    jan feb mar apr jun jul aug sep sept oct nov dec""".split()
)
#: May end a sentence although they are abbreviations.
MAY = set(
    """etc usw al inc ltd co corp bros jr a.m p.m am pm u.s u.k u.s.a u.n ph.d b.c a.d no jan feb mar apr jun jul aug sep sept oct nov dec др г гг тыс млн млрд
    руб κ.ά κ.λπ κλπ uu u.u""".split()
)
#: Words before a single letter that make it a label, not an initial.
LABELS = set(
    """group groups app appendix appendices class type part section sec table tab figure fig panel case step option plan team model version phase set
    category grade level vitamin hypothesis theorem lemma point item variant scheme annex exhibit schedule line block gruppe anhang teil typ klasse fall grupo apéndice ap
    anexo parte tipo clase groupe annexe partie type classe группа группы группе прил приложение приложении тип часть вариант ομάδα παράρτημα""".split()
)
#: Words before a number with a full stop that make it an ordinal.
ORDINAL = set("der die das dem den des am im vom zum zur beim ans ins jeder jede jedes jedem ein eine einem einen dieser diese diesem und bis seit ab".split())
#: Single lower-case letters that abbreviate.
LETTERS = set("psvncdfzhuitmkltе к т с м н п ч κ".replace(" ", ""))

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯“”…"
_IS_CJK = regex.compile(rf"[{_CJK}]")
_IS_THAI = re.compile(r"[฀-๿]")
_LINE = r"(?:\r\n|[\n\r\x85\u2028\u2029])"
_BLANK = re.compile(rf"{_LINE}[^\S\n\r\x85\u2028\u2029]*{_LINE}\s*")
_ITEM = r"(?:[•◦▪▫‣⁃●○■□*·∙–—-]|\(?\d{1,3}[.)]|（\d{1,3}）|\d{1,3}[、．]|\(?[a-zA-Z][)])"
_LINES = "\n\r\x85\u2028\u2029"
_FIRST = MARKS + _LINES
#: The characters that symbols start with; ";" and spaces only where Greek or Thai occurs.
_EVENT, _EVENT_ALL = re.compile(f"[{re.escape(_FIRST)}]"), re.compile(f"[{re.escape(_FIRST)}; \t\xa0]")
#: Openers and closers.
_QUOTE = re.compile("[" + re.escape("".join(dict.fromkeys("".join(PAIRS) + "".join(PAIRS.values())))) + "]")
_RARE = re.compile("[Ͱ-Ͽἀ-῿]{3}|[฀-๿]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_RUN = re.compile(f"[{re.escape(MARKS)}]+")
_BREAK = re.compile(rf"(?P<blank>{_LINE}[^\S{_LINES}]*{_LINE}\s*)|(?P<item>{_LINE}[^\S{_LINES}]*(?={_ITEM}[^\S{_LINES}]))")
_THAI_SPACE = re.compile(rf"[^\S{_LINES}]+(?=[฀-๿])")
_MARKSET, _LINESET = set(MARKS), set(_LINES)
#: A list mark and a label that end where an opener stands, and what they end with.
_LABEL = regex.compile(r"(?:(?:[•◦▪▫‣⁃●○■□*·∙–—-]|\(?\d{1,3}[.)]|（\d{1,3}）|\d{1,3}[、．]|\(?[a-zA-Z][)])\s+)?(?:(?:\p{Lu}\p{L}{0,9}|\p{L}{1,2})\s?[:：]\s*)?\Z")
_LABEL_ENDS = "•◦▪▫‣⁃●○■□*·∙–—-.)）、．:："
#: Two letters of one word that is no label.
_JOINT = regex.compile(r"(?<=[\p{L}\p{M}])\p{L}(?:[\p{L}\p{M}]{12}|[\p{L}\p{M}]{0,11}+(?!\s?[:：]))")
_NOTE = re.compile(r"(?:\[\s?\d(?:[\d\s,;，、–-]{0,24}\d)?\s?\])*")
_PART = r"[\p{L}\p{M}\p{N}°º§--\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
#: In scripts without spaces a line break may part a note from its mark.
_WRAPPED_NOTE = regex.compile(rf"\r?\n\[\s?\d(?:[\d\s,;，、–-]{{0,24}}\d)?\s?\](?=[{_CJK}])")
_NOTES = re.compile(r"(?:\[\s?\d(?:[\d\s,;，、–-]{0,24}\d)?\s?\])+$")
_WORD = regex.compile(rf"{_PART}(?:(?:{_PART}|['’.-])*{_PART})?$", regex.V1)
_LAST = regex.compile(_PART, regex.V1)
_MARK = regex.compile(r"\p{M}")
_MIXED = regex.compile(r"\p{Ll}+[\p{Lu}\p{Nd}]")
_SPACE = re.compile(r"\s*")
_DIGITS = re.compile(r"\d{1,3}")



def _starts(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can begin a sentence: no lower-case word, unless of mixed case."""
    n = len(text)
    for _ in range(5):
        if at >= n:
            return True
        c = text[at]
        if c in OPENERS or c in "–—-•":
            at += 1
            while at < n and text[at] in " \xa0 ":
                at += 1
        else:
            break
    if at >= n or not text[at].islower():
        return at >= n or text[at] not in ",;:)]}，；：、،؛"
    return _MIXED.match(text, at) is not None


def _word_before(text: str, lo: int, at: int) -> tuple[str, bool] | None:
    """(word, whether a full stop follows it): the last word of text[lo:at], white space and full stops after it aside."""
    i = at
    while i > lo and (text[i - 1] == "." or text[i - 1].isspace()):
        i -= 1
    j = i
    while j > lo and ((c := text[j - 1]).isalnum() or c in "'’-" or c > "\u02ff" and _MARK.match(c)):
        j -= 1
    return (text[j:i], "." in text[i:at]) if j < i else None


def _full_stop(text: str, at: int, after: int, item: bool = False) -> bool:
    """Whether the single full stop at ``at`` can end a sentence, given that something that can begin one stands at
    ``after``; ``item`` if that is a list item's mark."""
    word = text[text.rfind(" ", max(0, at - 24), at) + 1 : at] if at > 24 else ""
    if not (word.isalpha() and max(word) < "\u1100"):
        last = text[max(0, at - 1) : at]
        found = (last == "\n" or _LAST.match(last)) and _WORD.search(text[max(0, at - 24) : at])
        if not found:
            return True
        word = found[0]
    if "." in word and len(max(word.split("."), key=len)) > 3 and word.lower() not in NEVER:
        word = word.rsplit(".", 1)[1]  # a missing space
    low = word.lower()
    c = text[after] if after < len(text) else ""
    before_at = at - len(word)
    if word.isdigit():
        if not (c.isalpha() and c.isupper()):
            return True
        before = _word_before(text, max(0, before_at - 16), before_at)
        return not (before and before[0].lower() in ORDINAL)
    if low in MAY:
        if low == "al":
            return item or not (c in "(（" and after + 1 < len(text) and text[after + 1].isdigit())
        return not (low in NUMBERED and c.isdigit())
    if low in NEVER or low in NUMBERED or low in TITLES and word[0].isupper():
        return False
    if len(word) == 1 and word.isalpha():
        if word.isupper():
            before = _word_before(text, max(0, before_at - 20), before_at)
            # a label with a full stop of its own must be an abbreviation, else a sentence ended there
            return before is not None and (label := before[0].lower()) in LABELS and (not before[1] or label in NUMBERED)
        if word.islower():
            return low not in LETTERS or (low in "дп" and text[max(0, before_at - 3) : before_at].startswith("т."))
        return bool(_IS_CJK.match(word))
    if "." in word and all(len(x) == 1 and x.isalpha() for x in word.split(".")):  # E.U., т.е.
        return low in MAY
    return True


def _ends(text: str, start: int, stop: int) -> int:
    """The end of the sentence that the end mark at start:stop closes, or -1 if it closes none; nothing is open."""
    n = len(text)
    mark = text[start:stop]
    end = stop
    while end < n and text[end] in CLOSERS and not (text[end] in "\"'＂" and end + 1 < n and (text[end + 1].isalnum() or end > stop and text[end] == text[stop])):
        end += 1
    if end < n and text[end] == "[":
        end = _NOTE.match(text, end).end()
    hard = mark in HARD if len(mark) == 1 else any(c in HARD for c in mark)
    if hard and (wrapped := _WRAPPED_NOTE.match(text, end)):
        end = wrapped.end()
    after = _SPACE.match(text, end).end()
    if after >= n:
        return end
    spaced = after > end
    if text[after] in MARKS and _IS_CJK.match(text, after):
        return -1  # a run of marks broken by a line break
    before = text[start - 1] if start else ""
    if hard:
        if mark == "．" and before.isdigit() and not spaced and text[stop].isdigit():
            return -1
        return end
    cjk = _IS_CJK.match(text, after)
    if "!" in mark or "?" in mark or mark in "‼⁇⁈⁉":
        if spaced:
            return end if _starts(text, after) else -1
        glued = bool(before) and _IS_CJK.match(before) is not None
        return end if cjk or glued or (end > stop and _starts(text, after)) or text[after].isupper() else -1
    if "…" in mark or len(mark) > 1:
        if cjk or "…" in mark and before and _IS_CJK.match(before):
            return end
        return end if (spaced and _starts(text, after)) or text[after].isupper() else -1
    if spaced:
        # in scripts without spaces a line break may stand anywhere, in a number too
        if text[after].isdigit() and before.isdigit() and end == stop and _NEWLINE.match(text, end) and after - end <= 2 and _near_cjk(text, start, after):
            return -1
        return end if _starts(text, after) and _full_stop(text, start, after) else -1
    if text[max(0, start - 2) : start] == "al":
        return -1
    if cjk:
        return end if before and (_IS_CJK.match(before) or before in "%％)）]」”\"") or _full_stop(text, start, after) else -1
    # a missing space
    c = text[after]
    if before and _IS_CJK.match(before) and c.isalnum():
        return end
    if end > stop:
        return end if _starts(text, after) and _full_stop(text, start, after) else -1
    if c.isupper():
        glued = (before.islower() or before.isdigit() or before in ")]%") and not _ADDRESS.search(text[max(0, start - 40) : start])
        return end if glued and _full_stop(text, start, after) else -1
    caseless = c.isalpha() and not c.islower() and before.isalpha() and not before.islower() and not before.isupper()
    return end if caseless and _full_stop(text, start, after) else -1


_ADDRESS = re.compile(r"[/@\\]\S*$|\bwww\.\S*$")
_NEWLINE = re.compile(r"[\r\n]")


def _near_cjk(text: str, start: int, after: int) -> bool:
    return bool(_IS_CJK.search(text, max(0, start - 12), start) or _IS_CJK.search(text, after, min(len(text), after + 6)))


def _asks(text: str, at: int) -> bool:
    """Whether the ";" at ``at`` is a Greek question mark: a Greek letter stands before it or Greek words do."""
    return text[at] == ";" and at > 0 and (_GREEK.match(text, at - 1) is not None or len(_GREEK.findall(text, max(0, at - 40), at)) >= 8)


def _line_ended(text: str, at: int) -> bool:
    """Whether the line that ends at ``at`` may be followed by a list item: it ends a sentence, announces a list, or is
    of a script without end marks."""
    i = at
    while i and text[i - 1].isspace():
        i -= 1
    if not i or _IS_THAI.match(text[i - 1]) or text[i - 1] in ":：":
        return True
    if text[i - 1] == "]" and (note := _NOTES.search(text[max(0, i - 40) : i])):
        i -= len(note[0])
    while i and text[i - 1] in CLOSERS:
        i -= 1
        while i and text[i - 1] in " \xa0 ":
            i -= 1
    if not i or text[i - 1] not in MARKS and not _asks(text, i - 1):
        return False
    if text[i - 1] == "." and not (i > 1 and text[i - 2] == "."):
        return _full_stop(text, i - 1, _SPACE.match(text, at).end(), item=True)
    return True


def _in_sequence(text: str, at: int, mark: int) -> bool:
    """Whether the list number at ``mark`` follows the one before it, or is 1 and 2 comes soon."""
    number = _NUMBER.match(text, mark)
    if not number:
        return False
    k = int(number[1])
    earlier = [int(x) for x in _NUMBERS.findall(text, max(0, at - SPAN), at)]
    later = [int(x) for x in _NUMBERS.findall(text, mark, mark + SPAN)]
    return earlier[-1:] == [k - 1] or k == 1 and later[:1] == [2]


_NUMBER = re.compile(r"\(?(\d{1,3})[.)]\s")
_NUMBERS = re.compile(r"(?m)^[^\S\n]*\(?(\d{1,3})[.)]\s")


def _ended_inside(text: str, at: int) -> bool:
    """Whether an end mark stands right before the closer at ``at``."""
    i = at
    while i and text[i - 1] in " \xa0 \n\r":
        i -= 1
    return bool(i) and (text[i - 1] in MARKS or _asks(text, i - 1))


def _after_closer(text: str, stop: int, lead: bool, bracket: bool) -> int:
    """The end of the sentence at a closer before ``stop`` that an end mark stands before, or -1."""
    n = len(text)
    end = stop
    while end < n and text[end] in CLOSERS and text[end] not in "\"'＂":
        end += 1
    end = _NOTE.match(text, end).end()
    after = _SPACE.match(text, end).end()
    if after >= n:
        return end
    c = text[after]
    if c in ".,;:!?。，、；：！？．،؛؟…–—-)]）":
        return -1
    if bracket:
        return end if lead and _starts(text, after) and (after > end or _IS_CJK.match(c) or _IS_CJK.match(text[stop - 1])) else -1
    if not _starts(text, after):
        return -1
    if c.isalpha() and "぀" <= c <= "ゟ":  # a particle takes the quotation into the sentence
        return -1
    if after == end and ("가" <= c <= "힣" or c.isalpha() and not _IS_CJK.match(c) and not lead and c.islower()):
        return -1
    if lead:
        # words that report it follow in scripts without case; in others they would begin in lower case
        cased = c.isupper() or c.isdigit() or c in OPENERS
        if after == end or not cased:
            return -1
    return end


def _paired(text: str, opener: str, closer: str, blanks: list[int]) -> set[int]:
    """Positions of the openers of one kind that have a closer of their own before the next blank line."""
    out, opened, b = set(), [], 0
    for m in re.finditer(f"[{re.escape(opener + closer)}]", text):
        at = m.start()
        while b < len(blanks) and blanks[b] < at:
            opened.clear()
            b += 1
        if text[at] == opener:
            opened.append(at)
        elif opened:
            out.add(opened.pop())
    return out


def _closed_by(text: str, at: int, blanks: list[int], seen: dict) -> str:
    """What closes the opener at ``at`` before the next blank line, however far; "" if nothing does. ``seen`` keeps what
    was found in this text, so that looking for the closers of all its openers is linear in it."""
    opener, closers = text[at], PAIRS[text[at]]
    b = bisect_left(blanks, at)
    stop = blanks[b] if b < len(blanks) else len(text)
    if opener in seen:
        return closers if at in seen[opener] else ""
    first, by = stop, ""
    for k in closers:
        start, found = seen.get((k,), (0, -1))
        if not start <= at < found:
            found = text.find(k, at + 1)
            start, found = seen[(k,)] = at, found if found >= 0 else len(text)
        if found < first:
            first, by = found, k
    if by and len(closers) == 1 and opener != closers and text.find(opener, at + 1, first) >= 0:
        seen[opener] = _paired(text, opener, closers, blanks)
        return closers if at in seen[opener] else ""
    return by


# ---- pairs ----------------------------------------------------------------------------------------------------------
def covered(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of the outermost quotations and brackets of a text, in order, whatever their depth or length.

    ``end`` is the closer, or for one that crossing pairs leave open the blank line or the end of the text."""
    n = len(text)
    first = _QUOTE.search(text)
    if not first:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    ends = iter([*blanks, n, n + 1])
    limit, out, stack, since, seen = next(ends), [], "", 0, {}
    for m in _QUOTE.finditer(text, first.start()):
        at = m.start()
        if at > limit:
            if stack:
                out.append((since, limit, False))
                stack = ""
            while at > limit:
                limit = next(ends)
        c = text[at]
        if stack and (c == stack[-1] or c in stack and c not in '"＂'):
            stack = stack[: stack.rindex(c)]
            if not stack:
                out.append((since, at, True))
        elif c in PAIRS and at + 1 < n and not (c in '"＂' and (text[at + 1].isspace() or at and text[at - 1].isdigit())):
            closer = _closed_by(text, at, blanks, seen)
            if closer:
                if not stack:
                    since = at
                stack += closer
    if stack:
        out.append((since, limit, False))
    return out


# ---- the transducer -------------------------------------------------------------------------------------------------
#: States: nothing but a list mark or a label since the last boundary; a sentence has begun; in a quotation or bracket
#: that opened the sentence; in another one.
FRESH, BEGUN, LED, HELD = range(4)
STATES = (FRESH, BEGUN, LED, HELD)
#: Symbols: plain words, an end, a full stop after a number, a blank line, an opener, and closers by the states of
#: theirs after which they end the sentence: neither, both, LED, HELD.
WORDS, END, NUMBER, BLANK, OPEN, CLOSE, CLOSE_BOTH, CLOSE_LED, CLOSE_HELD = range(9)
#: NEXT[state, symbol] and whether a boundary is put out (CUTS[state, symbol]).
NEXT = np.array(
    [
        [BEGUN, FRESH, FRESH, FRESH, LED, FRESH, FRESH, FRESH, FRESH],
        [BEGUN, FRESH, FRESH, FRESH, HELD, BEGUN, BEGUN, BEGUN, BEGUN],
        [LED, LED, LED, FRESH, LED, FRESH, FRESH, FRESH, BEGUN],
        [HELD, HELD, HELD, FRESH, HELD, BEGUN, FRESH, BEGUN, FRESH],
    ],
    np.int8,
)
CUTS = np.array(
    [
        [0, 1, 0, 1, 0, 0, 0, 0, 0],
        [0, 1, 1, 1, 0, 0, 0, 0, 0],
        [0, 0, 0, 1, 0, 0, 1, 1, 0],
        [0, 0, 0, 1, 0, 0, 1, 0, 1],
    ],
    np.int8,
)
_NEXT, _CUTS = NEXT.tolist(), CUTS.tolist()


def _label_start(text: str, at: int) -> int:
    """Where a list mark or a label right before ``at`` starts, white space before it included; ``at`` is an opener."""
    p = at
    while p and text[p - 1].isspace():
        p -= 1
    if not p or (c := text[p - 1]) not in _LABEL_ENDS:
        return p
    before = text[p - 2 : p - 1] if p > 1 else ""
    # a number comes before a full stop or a comma, a number or a letter before a bracket
    if c in ".．、" and not before.isdigit() or c in ")）" and not before.isalnum():
        return p
    if m := _LABEL.search(text, max(0, at - 96), at):
        p = m.start()
        while p and text[p - 1].isspace():
            p -= 1
    return p


def _number_start(text: str, at: int) -> int:
    """Where a number of up to three digits right before ``at`` starts, with brackets and white space before it, or -1."""
    p = at
    while p and text[p - 1].isdigit():
        p -= 1
    if not 0 < at - p <= 3:
        return -1
    while p and text[p - 1] == "(":
        p -= 1
    while p and text[p - 1].isspace():
        p -= 1
    return p


def symbols(text: str, lo: int, hi: int, pairs: list[tuple[int, int, bool]], rare: bool) -> tuple[list[int], list[int]]:
    """(places, symbols) of text[lo:hi], each judged by its neighbourhood alone; a place is where its boundary would be.

    ``pairs`` are those of ``covered`` that touch the stretch; ``rare`` tells whether the text has Greek or Thai. What
    stands in a pair gives no symbol.
    """
    at_of, kinds = [], []
    put_at, put_kind = at_of.append, kinds.append
    events, skip, n = _EVENT_ALL if rare else _EVENT, lo, len(text)

    def words(p: int) -> None:
        """Plain words up to p, put before all that could cut there or later."""
        if p > 0:
            i = bisect_left(at_of, p)
            at_of.insert(i, p)
            kinds.insert(i, WORDS)

    if lo:
        put_at(lo)
        put_kind(WORDS)
    here = lo
    for opener, closer, closed in [*pairs, (hi, hi, False)]:
        for m in events.finditer(text, here, min(opener, hi)) if here < opener else ():
            at = m.start()
            if at < skip:
                continue
            c = text[at]
            if c in _MARKSET:
                if c == ".":  # most full stops are settled by what follows
                    d = text[at + 1 : at + 3]
                    if d and (d[0].islower() or d[0].isdigit() or d[0] in ",;") and not (at and _IS_CJK.match(text, at - 1)):
                        continue
                    if len(d) == 2 and d[0] == " " and d[1].islower() and not _MIXED.match(text, at + 2):
                        continue
                stop = _RUN.match(text, at).end() if at + 1 < n and text[at + 1] in _MARKSET else at + 1
                skip = stop
                end = _ends(text, at, stop)
                if end < 0:
                    continue
                skip = end
                number = _number_start(text, at) if c == "." else -1
                if number < 0:
                    put_at(end)
                    put_kind(END)
                else:
                    words(number)
                    put_at(end)
                    put_kind(NUMBER)
            elif c in _LINESET:
                line = _BREAK.match(text, at)
                if line is None:
                    continue
                skip = line.end()
                if line.lastgroup == "blank":
                    put_at(at)
                    put_kind(BLANK)
                elif text[skip] in "•◦▪▫‣⁃●○■□*·∙-" or _line_ended(text, at) or _in_sequence(text, at, skip):
                    put_at(at)
                    put_kind(END)
            elif c == ";":
                if _asks(text, at):
                    after = _SPACE.match(text, at + 1).end()
                    if after > at + 1 and _starts(text, after):
                        put_at(at + 1)
                        put_kind(END)
            elif at and "\u0e00" <= text[at - 1] <= "\u0e7f" and _THAI_SPACE.match(text, at):
                put_at(at)
                put_kind(END)
        if opener >= hi or closed and closer < skip:
            continue
        if opener >= lo:
            words(_label_start(text, opener))
            put_at(max(opener, skip))
            put_kind(OPEN)
        if not closed or closer >= hi:
            here = min(closer, hi)
            continue
        here, kind, end = closer + 1, CLOSE, closer
        if _ended_inside(text, closer):
            bracket = text[closer] in ")]}）］｝】〕〗"
            led, held = _after_closer(text, here, True, bracket), _after_closer(text, here, False, bracket)
            if led >= 0 or held >= 0:
                kind = CLOSE_BOTH if led >= 0 and held >= 0 else CLOSE_LED if led >= 0 else CLOSE_HELD
                skip = end = max(led, held)
        put_at(end)
        put_kind(kind)
    return at_of, kinds


def run_table(places: list[int], kinds: list[int], state: int = FRESH) -> list[int]:
    """The boundaries that the transducer puts out from one state."""
    out = []
    for at, kind in zip(places, kinds):
        if _CUTS[state][kind]:
            out.append(at)
        state = _NEXT[state][kind]
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """The compositions of all prefixes of state functions (rows: the state after, for every state before), by a
    parallel prefix scan: log rounds of independent compositions."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        step *= 2
    return out


def chunk_function(kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(state after for every state before, for every symbol a mask of the states before the chunk from which it puts
    out a boundary): the chunk as a function over all states."""
    each = np.array(kinds, np.intp)
    if not len(each):
        return np.array(STATES, np.int8), np.zeros(0, np.int8)
    after = scan(NEXT[:, each].T)
    before = np.concatenate((np.array([STATES], np.int8), after[:-1])).astype(np.intp)
    bits = CUTS[before, each[:, None]] << np.arange(len(STATES))
    return after[-1], bits.sum(1).astype(np.int8)


def chunk_starts(text: str, size: int) -> list[int]:
    """Where the chunks of a text start: after ``size`` characters, at the next place between two letters of a word that
    is no label, whatever the script. Nothing that is judged as one lies across it."""
    starts, at = [0], size
    while at < len(text) and (joint := _JOINT.search(text, at)):
        starts.append(joint.start())
        at = joint.start() + size
    return starts


def window(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The part of a text that the symbols of text[lo:hi] are judged by: ``REACH`` characters on both sides, more where
    they are nearly all white space."""
    a, b = max(0, lo - REACH), min(len(text), hi + REACH)
    while a and sum(map(len, text[a:lo].split())) < 200:
        a = max(0, a - REACH)
    while b < len(text) and sum(map(len, text[hi:b].split())) < 200:
        b = min(len(text), b + REACH)
    return a, b


def cut_chunks(text: str, size: int) -> list[tuple[int, int, int, int, list[tuple[int, int, bool]]]]:
    """(lo, hi, a, b, pairs) of the chunks of a text: a chunk's symbols are told from text[a:b] and the pairs alone."""
    starts, pairs, out, k = chunk_starts(text, size), covered(text), [], 0
    for lo, hi in zip(starts, [*starts[1:], len(text)]):
        while k < len(pairs) and pairs[k][1] < lo:
            k += 1
        j = k
        while j < len(pairs) and pairs[j][0] < hi:
            j += 1
        out.append((lo, hi, *window(text, lo, hi), pairs[k:j]))
    return out


def chunk_symbols(piece: str, lo: int, hi: int, a: int, pairs: list[tuple[int, int, bool]], rare: bool) -> tuple[list[int], list[int]]:
    """``symbols`` of a chunk given as the piece of the text from ``a`` on; places are those of the whole text."""
    places, kinds = symbols(piece, lo - a, hi - a, [(p - a, q - a, closed) for p, q, closed in pairs], rare)
    return [x + a for x in places], kinds


def boundaries(text: str, size: int = CHUNK) -> list[int]:
    """The ends of the sentences of a text, ascending; white space before a boundary is not cut off yet. Chunks are
    judged apart, each as a function over all states, and composed by prefix scan."""
    rare = _RARE.search(text) is not None
    if len(text) <= size:
        return run_table(*symbols(text, 0, len(text), covered(text), rare))
    chunks = [chunk_symbols(text[a:b], lo, hi, a, pairs, rare) for lo, hi, a, b, pairs in cut_chunks(text, size)]
    functions = [chunk_function(kinds) for _, kinds in chunks]
    entered = [FRESH, *scan(np.array([f for f, _ in functions]))[:-1, FRESH].tolist()]
    return [at for (places, _), (_, masks), state in zip(chunks, functions, entered) for at, m in zip(places, masks.tolist()) if m >> state & 1]


def sentences(text: str | None, size: int = CHUNK) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order; none for a null, empty or blank text."""
    if not text or text.isspace():
        return []
    out, start = [], 0
    for end in [*boundaries(text, size), len(text)]:
        if end <= start:
            continue
        a = _SPACE.match(text, start).end()
        b = end
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        start = end
    return out


def _whole(id_col: str):
    """An Arrow function over (id, text): the sentences of texts that are no longer than a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 512):
                own, places = [], []
                for k, text in enumerate(texts.slice(at, 512).to_pylist()):
                    found = sentences(text)
                    own += [at + k] * len(found)
                    places += found
                spans = np.array(places, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own, pa.int64())), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=[id_col, "start_at", "end_at"])

    return run


#: A chunk as a row; pairs are flattened.
CHUNK_ROW = "doc bigint, chunk int, lo bigint, hi bigint, a bigint, last boolean, rare boolean, pairs array<bigint>, piece string"
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.string()]


def _to_chunks(size: int):
    """An Arrow function over (id, text): the chunks of every text, with what their symbols are judged by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for k in range(len(ids)):
                text = batch.column(1)[k].as_py()
                rare = _RARE.search(text) is not None
                chunks = cut_chunks(text, size)
                for at in range(0, len(chunks), 64):
                    rows = [
                        (doc, at + i, lo, hi, a, hi == len(text), rare, [int(x) for p in pairs for x in p], text[a:b])
                        for i, (lo, hi, a, b, pairs) in enumerate(chunks[at : at + 64])
                    ]
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows), _CHUNK_TYPES)]
                    own = ids.take(pa.array([k] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *columns], names=["id", *[c.split()[0] for c in CHUNK_ROW.split(", ")]])
                doc += 1

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function over chunks: each as a function over all states, with its boundaries. A boundary has where the
    sentence before it ends, where the one after it begins, and a mask of the states before the chunk that put it out.
    The text's start and end are boundaries from every state."""
    cut = pa.struct([("ends", pa.int64()), ("begins", pa.int64()), ("mask", pa.int32())])
    for batch in batches:
        after, cuts = [], []
        for r in batch.select(["lo", "hi", "a", "last", "rare", "pairs", "piece"]).to_pylist():
            piece, lo, hi, a, p = r["piece"], r["lo"], r["hi"], r["a"], r["pairs"]
            pairs = [(p[i], p[i + 1], bool(p[i + 2])) for i in range(0, len(p), 3)]
            places, kinds = chunk_symbols(piece, lo, hi, a, pairs, r["rare"])
            function, masks = chunk_function(kinds)
            own = [{"ends": -1, "begins": _SPACE.match(piece, 0).end(), "mask": 15}] if not lo else []
            for at, mask in [*zip(places, masks.tolist()), *([(hi, 15)] if r["last"] else [])]:
                if mask:
                    end = at - a
                    while end and piece[end - 1].isspace():
                        end -= 1
                    own.append({"ends": end + a, "begins": _SPACE.match(piece, at - a).end() + a, "mask": mask})
            after.append(function.tolist())
            cuts.append(own)
        columns = [batch.column("id"), batch.column("doc"), batch.column("chunk"), pa.array(after, pa.list_(pa.int32())), pa.array(cuts, pa.list_(cut))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "doc", "chunk", "after", "cuts"])


def _entered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before every chunk of a document: the prefix scan over its functions, from the start."""
    pdf = pdf.sort_values("chunk")
    states = [FRESH, *scan(np.array(pdf["after"].tolist(), np.int8))[:-1, FRESH].tolist()]
    return pd.DataFrame({"doc": key[0], "chunk": pdf["chunk"], "state": states})


def split_long(df: DataFrame, id_col: str, size: int = CHUNK) -> DataFrame:
    """``split_sentences`` of the texts that are longer than a chunk: (id, text) without nulls.

    A document's chunks are judged in tasks of their own, each as a function over all states of the transducer; the
    functions (four numbers a chunk) are composed by prefix scan, which tells the state before each chunk and with it
    which of its boundaries hold. Sentences across chunks run from the last boundary before to the first one after.
    """
    kind = dict(df.dtypes)[id_col]
    chunks = df.mapInArrow(_to_chunks(size), f"id {kind}, {CHUNK_ROW}")
    # a fixed number of partitions, so that the chunks of one document are not put together again
    spread = chunks.repartition(spread_of(df), "doc", "chunk")
    judged = stage(spread.mapInArrow(_judged, f"id {kind}, doc bigint, chunk int, after array<int>, cuts array<struct<ends: bigint, begins: bigint, mask: int>>"))
    states = judged.select("doc", "chunk", "after").groupBy("doc").applyInPandas(_entered, "doc bigint, chunk int, state int")
    held = judged.drop("after").join(states, ["doc", "chunk"]).withColumn("cuts", F.expr("filter(cuts, x -> shiftright(x.mask, state) % 2 = 1)"))
    # one row a chunk here
    before = Window.partitionBy("doc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    open_ = held.withColumn("open", F.last(F.when(F.size("cuts") > 0, F.element_at("cuts", -1)["begins"]), ignorenulls=True).over(before)).filter("size(cuts) > 0")
    spans = F.expr("concat(array(struct(open as start_at, cuts[0].ends as end_at)), transform(slice(cuts, 2, size(cuts)), (x, i) -> struct(cuts[i].begins as start_at, x.ends as end_at)))")
    return open_.select("id", F.explode(spans).alias("s")).filter("s.start_at < s.end_at").select(F.col("id").alias(id_col), "s.start_at", "s.end_at")


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """(id, start_at bigint, end_at bigint): the sentences of every row's text, by code points.

    A null, empty or blank text gives no row; repeated rows give repeated rows; other columns are not read. Texts of up
    to ``size`` characters need no shuffle; of longer ones the chunks are spread over tasks (``split_long``).
    """
    own = df.select(id_col, text_col)
    long = F.length(text_col) > size
    short = own.filter(~long).mapInArrow(_whole(id_col), f"`{id_col}` {dict(df.dtypes)[id_col]}, start_at bigint, end_at bigint")
    return short.unionByName(split_long(own.filter(long), id_col, size))
