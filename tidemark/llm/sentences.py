"""Sentence units by semi-Markov dynamic programming.

A text is first cut where a unit must end whatever it says: blank lines, headings, list items, turn labels, fenced code.  Within
such a block every end mark outside quotation marks and brackets is a candidate, and dynamic programming picks the chain of spans
with the best sum of scores.  A span is scored as a whole: by its opening word, its closing word and mark, its length, and whether the
quotation it opens with is carried on after the closing mark.

How words open and close sentences is counted in all texts by Spark before any is cut: a word's rate at the start of blocks against its
rate within them, and, of a word with a full stop, its rate at the end of blocks against that of any word.  Only closed classes
(articles, conjunctions, auxiliaries) and public abbreviations are given beforehand.

Texts are cut one at a time, in time linear in their length.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import spread

# Turn labels, and public abbreviations and closed word classes of the ten languages (and a few more).
ROLES = "user assistant system agent me you reviewer human bot ai tool operator".split()
TITLES = frozenset((
    "dr mr mrs ms mx prof st rev hon gen lt col sgt cpl pvt capt cpt cmdr maj adm brig rep sen gov pres amb supt insp messrs mmes "
    "hr fr frl dipl ing mme mlle mgr dott dott.ssa sig sig.ra avv geom rag sr sra srta dra d dña lic arq д-р г-н г-жа проф акад доц тов डॉ श्री श्रीमती द"
).split())
BEFORE_NUMBER = frozenset((
    "no nr nº n° núm num sec fig figs tab ext v vol ver approx min max ca zl z kap chap ch art par env aprox cap lib abs est bd jg рис стр табл гл п пп p pp pág s tel "
    "jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic янв фев апр авг сент окт ноя дек"
).split())
WITHIN = frozenset("vs e.g i.e cf viz resp al op loc ibid approx bzw z.b d.h vgl ggf evtl inkl exkl bes insb u.ä sog z.t u.u o.g p.ex p.ej c.-à-d env ca aprox zl рис см ср напр т.е т.н т.к ext тыс млн млрд ред изд s".split())
EITHER = frozenset("etc usw u.a u.v.m a.m p.m u.s u.k u.n e.u d.c inc ltd co corp bros dept cit jr sr ph.d m.d b.c a.d т.д т.п др г гг в вв jh jr ff f min max no sec fig น พ.ศ ค.ศ".split())
LISTED = TITLES | BEFORE_NUMBER | WITHIN | EITHER
ORDINAL_LEAD = frozenset("der die das am dem den des vom zum zur beim im jeder jede ein einem einen bis ab seit und".split())
OPENING_WORDS = frozenset((
    "the a an this that these those it we he she they you i our my your his their its there here what why who how where nobody somebody someone anyone everyone nothing each every "
    "both all no not none please then now however but der die das ein eine es er sie wir ich dies diese dieser niemand jemand bitte warum wer wie wo le la les un une des ce cette il elle ils elles nous vous je "
    "pourquoi qui el los las una lo este esta yo nadie por qué quién cómo по почему кто это этот эта мы он она они я вы никто"
).split())
GOING_ON = frozenset((
    "and or but nor und oder aber sowie et ou mais ni y e o u pero и или но а "
    "is are was were be been am has have had do does did can could will would should may might must ist sind war waren wird werden hat haben kann soll muss est sont était étaient a ont avait sera seront peut "
    "es son era eran fue fueron está están ha han será puede был была было были есть будет будут может "
    "than which whose whom als dass welche welcher que dont du de del der des af of что чтобы который"
).split())
WEEKDAYS_AND_MONTHS = frozenset((
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun today tomorrow yesterday sharp est edt pst pdt utc gmt cet "
    "january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag"
).split())
TAG_KANA = "とはがをにのもでへや"

MARKS = ".!?…。！？।॥؟۔．｡|။។៕།።։"
FULL = "。！？．｡။។៕།።"
OPEN_QUOTES = {"«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
OPENED_BY: dict[str, list[str]] = {}
for _a, _b in OPEN_QUOTES.items():
    OPENED_BY.setdefault(_b, []).append(_a)
CLOSERS = "\"'”’“»«)）]】》」』"

FENCE = re.compile(r"^[ \t]*(```|~~~)")
HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]+\S")
BULLET = re.compile(r"^[ \t]*(?:>[ \t]?)*[ \t]*[-*+•‣–][ \t]+\S")
NUMBERED = re.compile(r"^[ \t]*(?:>[ \t]?)*[ \t]*(\d{1,3})([.)])[ \t]+\S")
LABEL = re.compile(r"^[ \t]*(?:\[[^\]\n]{4,40}\][ \t]*)(?:[^\s:：][^:：\n]{0,30})[:：](?=\s|$)|^[ \t]*(?:" + "|".join(ROLES) + r")[ \t]*[:：](?=\s|$)", re.I)
HEAD = re.compile(r"(?:\s|>|#{1,6}(?=\s)|[-*+•‣–](?=\s)|\d{1,3}[.)](?=\s))*")
THAI_SPACE = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
RUN = re.compile(r"[.!?…。！？।॥؟۔．｡။។៕།።։]+|(?<=[\u0900-\u097f])\|")
BREAK = re.compile(r"[\"«»„“”「」『』()（）\[\],;:]")
NEXT = re.compile(r"\S+")
_CJK = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003134f"  # Han, Hiragana, Katakana
CJK = re.compile(f"[{_CJK}]")
QUOTES = re.compile(r"[\"«»„“”「」『』()（）\[\]【】《》]")
ONE_LETTER = re.compile(r"(?:^|[\s(])([^\W\d_])\.\s+$")
MEASURE = re.compile(r"\d\s+\S{1,2}$")
ORDINAL = re.compile(r"(?:^|[\s\"„«])([^\s\"„«]+)\s+\d{1,2}$")
GLUED = re.compile(rf"[{_CJK}!?…。！？．｡।]+|(?<=\w\w)\.(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])")
FILELIKE = re.compile(r"^[\w\-]+(?:[/._][\w\-]+)+[.,;:!?…]*$")

NO = -12.0  # what never ends a unit
SHORT, LONG, SLOPE = 4, 600, 400  # characters: a fragment, a long sentence, and how fast longer ones lose


class Words:
    """How words open and close sentences: log-odds, 0 where nothing is known.

    ``opens``: of a lower-case word, that it opens rather than stands within (-4 to 4).  ``closes``: of a word with a full stop, that the stop ends a
    sentence rather than belongs to an abbreviation (-6 to 2).
    """

    def __init__(self, opens: dict[str, float] | None = None, closes: dict[str, float] | None = None):
        self.opens, self.closes = dict(opens or {}), dict(closes or {})
        for words, value in ((OPENING_WORDS, 1.5), (GOING_ON, -2.0)):
            for w in words:
                self.opens.setdefault(w, value)


PRIOR = Words()


def blocks(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """``start, end, head, whole`` of each block: head is where its text begins after marks and labels; whole blocks are one unit."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    start = head = None
    number, after_break, listed, i = None, True, False, 0

    def close(end: int):
        nonlocal start
        if start is not None and end > start:
            yield start, end, head, False
        start = None

    while i < len(lines):
        at, line = lines[i]
        lead = line.lstrip()
        plain = lead[:1].isalpha() and ":" not in line[:80] and "：" not in line[:80]  # no mark, no number, no label
        if plain:
            if start is None:
                start, head = at, at + len(line) - len(lead)
            after_break = False
            i += 1
            continue
        if FENCE.match(line):
            yield from close(at)
            fence, j = FENCE.match(line)[1], i + 1
            while j < len(lines) and not lines[j][1].lstrip().startswith(fence):
                j += 1
            end = lines[j][0] + len(lines[j][1]) if j < len(lines) else len(text)
            yield at, end, at, True
            i, after_break = j + 1, True
            continue
        if not lead:
            yield from close(at)
            after_break, listed, i = True, False, i + 1
            continue
        if HEADING.match(line):
            yield from close(at)
            m = HEADING.match(line)
            yield at, at + len(line), at + m.end() - 1, False
            after_break, i, number = True, i + 1, None
            continue
        opens = None
        if m := LABEL.match(line):
            opens, number = m.end(), None
        elif m := BULLET.match(line):
            opens, number = m.end() - 1, None
        elif m := NUMBERED.match(line):
            n = int(m[1])
            k = at
            while start is not None and k > start and text[k - 1].isspace():
                k -= 1
            ended = after_break or start is None or k == start or text[k - 1] in MARKS + CLOSERS + ":："
            if m[2] == ")" or after_break or (number is not None and n == number + 1) or (n == 1 and (ended or listed)):
                opens, number = m.end() - 1, n
        if opens is not None:
            yield from close(at)
            listed = not LABEL.match(line)
        if start is None:
            start, head = at, at + (opens if opens is not None else HEAD.match(line).end() if lead.startswith(">") else len(line) - len(lead))
            if opens is not None and (m := HEAD.match(line, opens)):
                head = at + m.end() if line[opens : m.end()].strip() and BULLET.match(line[opens:]) else at + opens
        after_break = False
        i += 1
    yield from close(len(text))


def pairs(text: str) -> dict[int, int]:
    """Matched quotation marks and brackets of a block, opening place to closing place; an opener without its closer is none.

    Each kind of opener has its own list of places in the stack, so that a closer finds its opener at once and nothing is scanned twice.
    """
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}

    def close(k: int, i: int) -> None:
        found[stack[k][1]] = i
        while len(stack) > k:
            where[stack.pop()[0]].pop()

    def push(c: str, i: int) -> None:
        where.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    for m in QUOTES.finditer(text):
        i, c = m.start(), m[0]
        if c == '"':
            held = where.get(c)
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            opens = (not before or before.isspace() or before in "(（[«„“「—–-:") and after and not after.isspace()
            if held and not (opens and after.isalnum() and NEXT.search(text, stack[held[-1]][1] + 1, i) is None):
                close(held[-1], i)
            elif not held and (opens or not before.isalnum()):
                push(c, i)
            continue
        last = max((held[-1] for o in OPENED_BY.get(c, ()) if (held := where.get(o))), default=None)
        if last is not None:
            close(last, i)
        elif c in OPEN_QUOTES:
            push(c, i)
    return found


def _abbreviation(before: str) -> str:
    """The word that ends at a full stop, with a spaced one-letter part before it ('z. B' is 'z.b')."""
    if not before or before[-1].isspace():
        return ""
    token = before.split()[-1]
    if len(token) > 2 and token.isalpha() and token < "\u3000":
        return token.lower()
    word = GLUED.split(BREAK.split(token)[-1].rstrip("."))[-1].lower()
    if len(word) <= 2 and (p := ONE_LETTER.search(before[: len(before) - len(token)])):
        word = f"{p[1].lower()}.{word}"
    return word


def _opening(word: str, words: Words) -> float:
    return words.opens.get(word.strip("\"'«„“”»「」『』¿¡()[]（）.,;:!?…").lower(), 0.0)


def boundary(text: str, mark: str, at: int, end: int, nxt: int, word: str, quote: int | None, spaced: bool, match: dict[int, int], words: Words) -> float:
    """How well a unit may end at ``end`` and the next one open with ``word`` at ``nxt``: closing word, mark and opening word together.

    Single sentences may be in lower case throughout, so a small letter alone says little; closing and opening words decide.
    """
    c = word[0]
    if c in ",;:，；、—–":
        return NO
    first = word.lstrip("\"'«„“「『¿¡([（")[:1] or c
    quoted = c in "\"«„“「『¿¡"
    if c in "(（" and (close := match.get(nxt)) is not None:
        quoted = text[close - 1] in MARKS  # a sentence of its own in brackets
    upper = first.isupper() or first.isdigit()
    lower = c.islower() and not FILELIKE.match(word)
    if quote is not None:  # the mark stands inside the quotation or bracket that closes here
        if first in TAG_KANA:
            return NO
        if lower:
            o = _opening(word, words)
            return NO if o <= -1 else 1.0 + o
        return 4.0
    if mark[0] == "…" or mark.endswith("…") or mark.endswith(".."):
        return 3.0 if upper or quoted else -6.0
    if mark != ".":
        return 8.0 if not lower or mark[-1] not in "!?؟" else 4.0 + 2 * min(0.0, _opening(word, words))
    before = text[max(0, at - 40) : at]
    abbr = _abbreviation(before)
    tail = abbr.rsplit(".", 1)[-1]
    either = abbr in EITHER
    if not spaced:  # a full stop with a letter right after it
        known = len(tail) == 1 and tail.isalpha() and not either
        return NO if known or abbr in TITLES or abbr in WITHIN else 3.0
    listed = abbr in TITLES or abbr in WITHIN or abbr in BEFORE_NUMBER
    if listed or len(tail) == 1:
        measured = not either and MEASURE.search(before) is not None  # '7 ms.', '9 s.'
        if not measured:
            if abbr in TITLES:
                return NO
            if first.isdigit() and abbr in BEFORE_NUMBER:
                return NO
            if abbr in WITHIN:
                return NO if not (quoted or upper) else max(NO, -6.0 + words.closes.get(abbr, 0.0))
            if not either and tail.isalpha() and len(tail) == 1 and not CJK.match(tail):
                return NO
    if either or abbr in BEFORE_NUMBER:
        plain = abbr in BEFORE_NUMBER  # min, max, no, dec: plain words unless a number follows
        if upper or quoted or not lower:
            dated = not plain and word.strip(".,;:!?").lower() in WEEKDAYS_AND_MONTHS  # 'at 5 p.m. Monday'
            return -4.0 if dated else 4.0 if upper or quoted or FILELIKE.match(word) else -3.0
        return 2.0 * _opening(word, words) + (0.0 if plain else max(-4.0, words.closes.get(abbr, words.closes.get(tail, -1.0))))
    if tail.isdigit() and not first.isdigit():
        lead = ORDINAL.search(before)
        if lead and lead[1].lower() in ORDINAL_LEAD:
            return NO
        if lower and word in GOING_ON and _opening(word, words) < -1:
            return NO  # 'version 3.2. was'
    closing = words.closes.get(abbr, 0.0)
    return (3.0 if lower else 5.0) + (2 * closing if closing < -2 else 0.0)


def candidates(text: str, words: Words) -> tuple[list[tuple[int, int, float, int | None]], dict[int, int]]:
    """Places where a unit may end: place, start of what follows, score, and the opening place of the quotation that ends there with a mark inside."""
    match = pairs(text) if QUOTES.search(text) else {}
    opened = set(match.values())
    out, k, reach = [], 0, -1
    closed_by: list[tuple[int, int]] = []
    # outermost pairs, as stretches that must not be split
    for a, b in sorted(match.items()):
        if a > reach:
            closed_by.append((a, b))
            reach = b
    size = len(text)

    def put(end: int, quote: int | None, at: int, mark: str, spaced: bool) -> None:
        if (m := NEXT.search(text, end)) is None:
            return  # the end of the block
        word = m[0]
        if mark == "." and spaced and quote is None and word[0].isupper():
            abbr = _abbreviation(text[max(0, at - 40) : at])
            if len(abbr) > 2 and abbr not in LISTED and not abbr[-1].isdigit() and (abbr[-2] != "."):
                closing = words.closes.get(abbr, 0.0)
                out.append((end, m.start(), 5.0 + (2 * closing if closing < -2 else 0.0), None))
                return
        s = boundary(text, mark, at, end, m.start(), word, quote, spaced, match, words)
        if s > NO:
            out.append((end, m.start(), s, quote))

    for m in RUN.finditer(text):
        at, end, mark = m.start(), m.end(), m[0]
        if mark == "." and end < size and ((c := text[end]).isdigit() or c.islower()):
            continue  # decimals, versions, file names
        while k < len(closed_by) and closed_by[k][1] < at:
            k += 1
        quote = None
        if k < len(closed_by) and closed_by[k][0] < at:
            quote, stop = closed_by[k]
            if stop > end and text[end:stop].strip(" \u00a0\u202f" + CLOSERS) if stop - end < 12 else stop > end:
                continue
            end = stop + 1
            while end < size and text[end] in CLOSERS and end not in match:
                end += 1
            if RUN.match(text, end) is not None:  # «...!». takes the outer mark as its own
                continue
        else:
            while end < size and text[end] in CLOSERS and end not in match and end in opened:
                end += 1
        nxt = text[end : end + 1]
        spaced = not nxt or nxt.isspace()
        if not spaced:
            prev = text[at - 1 : at]
            if mark[-1] in FULL + "…।":
                if mark[-1] == "．" and nxt.isdigit() and prev.isdigit():
                    continue
            elif mark[-1] in "!?؟" and (nxt.isalnum() or nxt in "\"«„“「(¿¡['[*#"):
                pass
            elif mark == "." and quote is None and (nxt.isupper() or nxt in "\"«„“¿¡(") and prev and not prev.isspace():
                after = text[end : end + 2]
                if nxt.isupper() and not (len(after) == 2 and (after[1].islower() or after[1].isspace() or after[1] == ".")):
                    continue
            elif quote is not None and (nxt.isupper() or nxt in "\"«„“「¿¡(" or CJK.match(nxt)):
                pass
            elif CJK.match(nxt) and mark == "." and CJK.match(prev or " "):
                pass
            else:
                continue
        elif mark == "." and (at == 0 or text[at - 1].isspace()):
            continue
        put(end, quote, at, mark, spaced)
    k = 0
    for m in THAI_SPACE.finditer(text):
        while k < len(closed_by) and closed_by[k][1] < m.start():
            k += 1
        if k == len(closed_by) or closed_by[k][0] > m.start():
            out.append((m.start(), m.end(), 20.0, None))
    out.sort(key=lambda c: c[0])
    return out, match


def quotation_score(text: str, quote: int, end: int, nxt: int, leads: bool) -> float:
    """The score of a span whose last quotation opens at ``quote`` and holds the closing mark; ``leads``: the span opens with that quotation, or the
    quotation stands after another mark."""
    c = text[nxt]
    if text[quote] in "(（[【":
        return -10.0 if not leads and c.islower() else 0.0  # a bracket within a sentence that goes on
    if leads and c not in "\"«„“「『¿¡([（":
        k = end
        while k > quote and text[k - 1] in CLOSERS + " \u00a0\u202f":
            k -= 1
        return -14.0 if text[k - 1] in "?!؟？！" else 0.0  # "…?" somebody asked: the sentence goes on after the quotation it opens with
    return 0.0


def chain(text: str, cands: list[tuple[int, int, float, int | None]]) -> list[int]:
    """The places where the best chain of spans is cut.

    A span from start i to candidate j scores the boundary at j, the quotation it ends with, less 2 for a bare fragment and, beyond LONG
    characters, its excess over SLOPE.  Of all earlier starts only two can be best: the one that is best within LONG characters, which a
    queue holds, and the one best beyond, a running maximum, since there the loss grows by the same amount for each.  So all
    spans of any length are weighed in linear time.
    """
    n = len(cands)
    base = [0.0] * (n + 1)  # best sum up to start i
    back = [0] * (n + 1)
    near: deque[int] = deque()  # earlier starts within LONG, their base falling
    far, far_at = float("-inf"), -1  # best of base + start / SLOPE beyond
    starts = [0, *(c[1] for c in cands)]
    held = 0  # starts up to here have gone into ``near``
    gone = 0  # and up to here have left LONG
    for j in range(n + 1):
        end, nxt, score, quote = cands[j] if j < n else (len(text), None, 4.0, None)
        while held < j:
            while near and base[near[-1]] <= base[held]:
                near.pop()
            near.append(held)
            held += 1
        while gone < j and starts[gone] < end - LONG:
            if base[gone] + starts[gone] / SLOPE > far:
                far, far_at = base[gone] + starts[gone] / SLOPE, gone
            gone += 1
        while near and near[0] < gone:
            near.popleft()
        start = starts[j]
        leads = inner = False
        if quote is not None:
            k = quote  # what stands before the quotation, without markup: a mark, or the span's own start
            while k > 0 and text[k - 1] in "\"'*_>- \t\n":
                k -= 1
            leads = k <= start
            while k > 0 and text[k - 1] in CLOSERS:
                k -= 1
            inner = k > 0 and text[k - 1] in MARKS
            leads = leads or inner
        fragment = end - start < SHORT and text[start : end - 1].isalnum() and not CJK.search(text, start, end)
        best = base[j] - (2.0 if fragment else 0.0) - max(0, end - start - LONG) / SLOPE + (quotation_score(text, quote, end, nxt, leads) if quote is not None else 0.0)
        at = j
        other = quotation_score(text, quote, end, nxt, inner) if quote is not None else 0.0
        if near and base[near[0]] + other > best:
            best, at = base[near[0]] + other, near[0]
        if far_at >= 0 and far - (end - LONG) / SLOPE + other > best:
            best, at = far - (end - LONG) / SLOPE + other, far_at
        back[j] = at
        if j < n:
            base[j + 1] = best + score
    cuts, j = [], n
    while back[j] > 0:
        j = back[j] - 1
        cuts.append(cands[j][0])
    return cuts[::-1]


def units(text: str, words: Words = PRIOR) -> list[tuple[int, int]]:
    """``start, end`` of each unit in code points."""
    out: list[tuple[int, int]] = []

    def put(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    for start, end, head, whole in blocks(text):
        if not whole:
            body = text[head:end]
            cands, _ = candidates(body, words)
            if cands:
                a = start
                for cut in chain(body, cands):
                    put(a, head + cut)
                    a = head + cut
                put(a, end)
                continue
        put(start, end)
    return out


# Counting in all texts.  Only words of scripts with small letters matter.
_WORD = r"[^\W\d_][\w'’\-]{0,23}"
OPENING = re.compile(r"(?:\A\s*|\n[ \t]*\n\s*|\n[ \t]*(?:[-*+•‣–]|\d{1,3}[.)])[ \t]+|[!?][ \t\n]+)[\"«„“(\[¿¡]*(" + _WORD + ")")
STOPPED = re.compile(r"\.(?:([\"”»)\]]*[ \t]*(?:\Z|\n[ \t]*(?:\n|\Z|[-*+•‣–#])))|[,;:]|(?:[ \t]+\n?[ \t]*|\n[ \t]*)([^\W_]))")
EDGES = "\"'«„“”»([{¿¡)]}.,;:!?…"
FLUSH = 500_000  # words a task holds before it hands its counts on
LEAST, MOST_WORDS = 8, 50_000


def count_words(documents: DataFrame) -> DataFrame:
    """``word, o, i, e, m`` over all texts: how often a word opens a block or follows a sure mark, stands in small letters anywhere, closes a block
    with a full stop, or has a comma, number or small letter after its full stop.  Counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, tokens, ends, goes = Counter(), Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out: dict[str, list[int]] = {}
            for k, counter in ((0, opens), (1, tokens), (2, ends), (3, goes)):
                for w, n in counter.items():
                    w = w.strip(EDGES) if k == 1 else w
                    if w[:1].islower() and len(w) <= 24 and w != "":
                        out.setdefault(w, [0, 0, 0, 0])[k] += n
                counter.clear()
            cols = [pa.array(list(out)), *(pa.array([n[k] for n in out.values()], pa.int64()) for k in range(4))]
            return pa.RecordBatch.from_arrays([cols[0].cast(pa.string()), *cols[1:]], names=["word", "o", "i", "e", "m"])

        for b in batches:
            for text in b.column("text").to_pylist():
                tokens.update(text.split())
                opens.update(map(str.lower, OPENING.findall(text)))
                for m in STOPPED.finditer(text):
                    if (after := m[2]) is None or after.islower() or after.isdigit():
                        at = m.start()
                        before = text[max(0, at - 13) : at].split()
                        word = before[-1].lstrip(EDGES).lower() if before and text[at - 1] > " " else ""
                        if 0 < len(word) <= 12:
                            (goes if m[1] is None else ends)[word] += 1
            if len(tokens) + len(opens) + len(ends) + len(goes) > FLUSH:
                yield flush()
        yield flush()

    texts = documents.select("text").filter("text is not null")
    return texts.mapInArrow(run, "word string, o bigint, i bigint, e bigint, m bigint").groupBy("word").agg(*[F.sum(k).alias(k) for k in "oiem"])


def learned(documents: DataFrame, least: int = LEAST, most: int = MOST_WORDS) -> Words:
    """Log-odds from the counts of all texts.  The table is bounded: the ``most`` commonest words that occur ``least`` times; others have none.

    Opening: rate among openers over rate within, smoothed towards what is given beforehand.  Closing: likelihood of the word's ends at blocks
    under the rate of all words against that of an abbreviation, which hardly ever ends one.
    """
    counts = count_words(documents)
    kept = counts.cache()
    try:
        o, i, e, m = (x or 0 for x in kept.agg(*[F.sum(k) for k in "oiem"]).first())
        rows = kept.filter(F.col("o") + F.col("i") + F.col("e") + F.col("m") >= least).orderBy(F.desc(F.col("o") + F.col("i") + F.col("e") + F.col("m")), "word").limit(most).toPandas()
    finally:
        kept.unpersist()
    import numpy as np

    prior = rows["word"].map(PRIOR.opens).fillna(0.0).to_numpy(float)
    n = (rows["o"] + rows["i"]).to_numpy(float)
    odds = np.log((rows["o"] + 0.5) / (o + 1)) - np.log((rows["i"] + 0.5) / (i + 1))
    opens = np.clip((n * odds + 10 * prior) / (n + 10), -4, 4)
    rate, rare = min(0.9, max(0.02, (e + 1) / (e + m + 4))), 0.005
    closes = np.clip(rows["e"] * np.log(rate / rare) + rows["m"] * np.log((1 - rate) / (1 - rare)), -6, 2)
    return Words(dict(zip(rows["word"], opens)), {w: v for w, v in zip(rows["word"], closes) if v})


def sentence_units(documents: DataFrame, words: Words | None = None) -> DataFrame:
    """``doc_id, start_char, end_char`` of every unit.  Null, empty and blank texts have none; a document without id has no units.

    ``words``: how words open and close sentences, by default counted in these documents.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(words if words is not None else learned(documents))  # at most MOST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, starts, ends = [], [], []

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_char", "end_char"])
            ids.clear(), starts.clear(), ends.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = units(text, known)
                ids.extend([doc] * len(found))
                starts.extend(a for a, _ in found)
                ends.extend(z for _, z in found)
                if len(ids) >= 50_000:
                    yield flush()
        if ids:
            yield flush()

    rows = spread(documents.select("doc_id", "text").filter("text is not null and doc_id is not null"), "doc_id")
    return rows.mapInArrow(run, "doc_id bigint, start_char bigint, end_char bigint")
