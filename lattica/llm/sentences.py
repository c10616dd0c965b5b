"""Sentence boundaries across languages and scripts: a hidden-event n-gram language model.

Between the words of a text the model has hidden events, boundary or none. A boundary's weight comes from the n-gram to its
left (the word before, with its stop, closing quotes and the kind of gap; with the word before that for numbers, and
whether an event came just before) and from the word to its right, which follows either the event or running text. The
posteriors of all events of a text come from the forward-backward algorithm; a boundary is where its posterior is above a
half. Only gaps that layout decides are fixed beforehand: blank lines, numbered paragraphs and claims, formula lines,
the inside of quotations and brackets, spaces between Thai words.

The model is trained here on all documents, without labelled text: events at paragraph ends are known, events after stops are hidden and
estimated by expectation maximisation, starting from what begins paragraphs and what stands in running text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.sources.tables import load, materialize

EM_ROUNDS = 6
#: Characters at the end of a word that tell it from others before a stop: longer than any abbreviation.
WORD_END = 40
#: Characters a text has between white space on average, from which its words are counted one by one.
TOKEN = 20

#: Words whose stop mostly is part of the word, fixed values: a prior for the model's counts.
ABBREVIATIONS = frozenset(
    "no nos fig figs dr mr mrs ms prof st inc corp ltd co pat cf e.g i.e viz vs approx ca min max sec para paras p pp vol al et u.s a.m p.m deg wt.% ser eq eqs ref refs ex "
    "nr abb tab bzw z.b d.h u.a vgl bspw sog evtl ggf inkl max pos ziff abs "
    "p.ex c.-à-d env cf tabl m mme rev éd "
    "рис п пп см напр др т.е т.д т.п прибл табл фиг стр г "
    "क्र डॉ मि.मी कि.मी से.मी श्री".split()
)
#: Abbreviations that also end sentences.
_OPEN = frozenset("etc usw u.a u.ä и.др др т.д т.п".split())

_CJK = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿"
_THAI = "฀-๿"
_CLOSERS = "\"”“’»›」』）)\\]】］》"
_HIT = re.compile(r"[.．!?。！？｡।॥…|\n]")
_HIT_THAI = re.compile(rf"[.．!?。！？｡।॥…|\n]|(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}])")
_THAI_SIGN = re.compile(f"[{_THAI}]")
_PAIRED = re.compile(r"\n\n|[\"“”„«»「」『』()（）]")
#: What opens a span that a sign closes, fixed values.
_OPENERS = {"”": "“„", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（"}
_MARK = re.compile(r"(?:\[\s*\d{2,6}\s*\]|【\s*(?:\d+|[^】\n]{0,4}請求項[^】\n]{0,8}|[^】\n]{1,30})\s*】|(\d{1,4})\s*[.．)、](?!\d))")
_NUMBERED = re.compile(r"[【\[][^】\]\n]*[\d０-９]+\s*[】\]]$")
_HEADING = re.compile(r"【[^】\n]*[^】\d０-９\n][】]$")
_LEFT = re.compile(r"(\S*?)[.．!?…]*$")
_WORD = re.compile(rf"[{_CJK}]{{1,2}}|[^\s{_CJK}{_CLOSERS},;:，；：、.]+(?:\.[^\s{_CJK}{_CLOSERS},;:，；：、.]+)*|\S")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s*")
#: What a word's key starts behind.
_CUTS = "([{（“„«\"「\t\u00a0\u3000"
_CUT = re.compile(f"[{re.escape(_CUTS)}]")
_CLOSE_SET = frozenset("\"”“’»›」』）)]】］》")
_STOP_SET = frozenset(".．!?。！？｡।॥…|")
_TAIL_SET = _CLOSE_SET | _STOP_SET
_RUN_SET = _STOP_SET - {"|"}
#: Signs that are nothing but full stops, fixed values.
_PURE_STOPS = "。！？｡।॥"
_OPENING = frozenset("\"“„«「『(（")
#: Where a word of running text starts that ends at white space only.
_LETTER = re.compile(rf"[^\W\d_{_CJK}]")
#: A word of running text; its group is what the word's key is made from.
_RUNNING = re.compile(rf"(?=\w|[\"“„«「『(（]\w)(?=([\"“„«「『(（]?(?:{_WORD.pattern})))(?:[\"“„«「『(（](?=\w)|[^\W\d_{_CJK}]\S*|[{_CJK}]{{2}}|\d+)")


def _shape(word: str) -> str:
    """Class of a word that the model has not met often enough."""
    if not word:
        return "<>"
    c = word[0]
    if "぀" <= c <= "鿿":
        return "<cjk>"
    if c.isdigit():
        return "<9>"
    if not c.isalpha():
        return "<" + c + ">"
    if len(word) == 1:
        return "<X>" if c.isupper() else "<x>"
    if word.isupper():
        return "<XX>"
    case = "Xx" if c.isupper() else "xx" if c.islower() else "o"
    return f"<{case}{'-' if '-' in word else ''}{ord(c) >> 8}>"


def _right(text: str, at: int) -> str:
    """Key of the word at ``at``; a quotation or bracket that opens there counts by the class of its first word."""
    if text[at : at + 1] in _OPENING:
        m = _WORD.match(text, at + 1)
        return text[at : at + 1] + _shape(m.group() if m else "")
    m = _WORD.match(text, at)
    if not m:
        return ""
    word = m.group()
    return word if word.isalpha() else _DIGITS.sub("9", word)


class Gap:
    """A place where a sentence may end: its end, the start of what follows, what is fixed, and the n-gram around it."""

    __slots__ = ("end", "next", "fixed", "left", "right", "near", "kind")

    def __init__(self, end: int, nxt: int, fixed: int | None, left: str, right: str, near: bool, kind: str) -> None:
        self.end, self.next, self.fixed, self.left, self.right, self.near, self.kind = end, nxt, fixed, left, right, near, kind


def _spans(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """The outermost quotations and brackets of a text in order, and the ends of all. Signs pair within a paragraph, however long.

    Signs nest; one left open is dropped when a span around it closes. A straight quote opens or closes by what touches it,
    and where that leaves it open, closes the one before, if any.
    """
    spans: list[tuple[int, int]] = []
    closes: set[int] = set()
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    for m in _PAIRED.finditer(text):
        sign, at = m.group(), m.start()
        if sign == "\n\n":
            stack.clear()
            held.clear()
            continue
        if sign == '"':
            before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
            opens, shuts = not (after.isspace() or after in ",.;:!?。，、！？" or after in _CLOSE_SET - {'"'}), not (before.isspace() or before in _OPENING - {'"'})
            if opens and not shuts:
                close = ""
                if stack and stack[-1][0] == '"':
                    held[stack.pop()[0]] -= 1
            else:
                close = '"'
                if not held['"'] and shuts and not opens:
                    continue
        else:
            close = "„" if sign == "“" else _OPENERS.get(sign, "")
        if any(held[c] for c in close):
            while True:
                c, start = stack.pop()
                held[c] -= 1
                if c in close:
                    break
            closes.add(at + 1)
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at + 1))
        elif sign not in _OPENERS:
            stack.append((sign, at))
            held[sign] += 1
    return spans, closes


def gaps(text: str) -> list[Gap]:
    """All candidate gaps of a text in order. ``fixed`` is 1 or 0 where layout decides, else None."""
    n = len(text)
    out: list[Gap] = []
    spans, closes = _spans(text)
    k, at, last_claim, line_start, seen = 0, 0, 0, 0, 0
    first_break = text.find("\n", n - len(text.lstrip()))
    thai_doc = _THAI_SIGN.search(text) is not None
    for m in (_HIT_THAI if thai_doc else _HIT).finditer(text):
        start = m.start()
        if start < at:
            continue
        sign = text[start]
        kind = "stop"
        if sign == "\n":
            kind, end = "line", start
            while end and text[end - 1] in " \t\r\u00a0\u3000":
                end -= 1
            start = end
        elif sign.isspace():
            kind, end = "thai", start
        else:
            end = start + 1
            if sign in ".．|":
                after = text[end] if end < n else "\n"
                before = text[start - 1] if start else " "
                if sign == "|":
                    if not (after.isspace() and ("\u0900" <= before <= "\u097f" or before == " ")):
                        continue
                elif not (after.isspace() or after in _TAIL_SET or after.isupper() or after >= "\u0900" or "぀" <= before <= "鿿") or before.isdigit() and after.isdigit():
                    continue
            while end < n and text[end] in _RUN_SET:
                end += 1
        inside = False
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if kind == "stop":
            while end < n and text[end] in _TAIL_SET:
                # A closing mark belongs to the sentence, an opening one (the same sign in some languages) does not.
                if text[end] in '"“' and end + 1 not in closes:
                    break
                end += 1
        j = k
        while j < len(spans) and spans[j][0] < start:
            inside |= spans[j][1] > end
            j += 1
        nxt = end
        if nxt < n and text[nxt].isspace():
            nxt += 1
            if nxt < n and text[nxt].isspace():
                nxt = _SPACE.match(text, nxt).end()
        at = nxt
        breaks = text.count("\n", end, nxt) if nxt > end else 0
        if nxt == n:
            out.append(Gap(end, nxt, 1, "", "", False, "end"))
            break
        if inside and breaks < 2:
            out.append(Gap(end, nxt, 0, "", "", False, "span"))
            continue
        right = _right(text, nxt)
        fixed: int | None = None
        # Only what lies behind the gap before is searched, as a line may be long.
        line_start = max(line_start, text.rfind("\n", seen, start) + 1)
        seen = start
        if kind == "thai":
            out.append(Gap(end, nxt, 1, "", right, False, "thai"))
            continue
        if breaks:
            mark = _MARK.match(text, nxt)
            claim = int(mark.group(1)) if mark and mark.group(1) else 0
            line = text[line_start:end].strip()
            indented = text[line_start : line_start + 2] == "  " and kind == "line"
            if breaks >= 2 or start <= first_break <= end + breaks or thai_doc and _thai_line(line, text, nxt):
                fixed = 1
            elif _NUMBERED.match(line):
                fixed = 0
            elif _HEADING.match(line) or mark and not claim:
                fixed = 1
            elif claim and (claim == last_claim + 1 or claim == 1 and kind == "stop"):
                fixed = 1
            elif text[nxt - 2 : nxt] == "  " or indented:
                fixed = 0
            elif _heading(text, line, nxt, kind):
                fixed = 1
            if claim and (fixed == 1):
                last_claim = claim
        elif kind == "stop":
            first, last = text[line_start], text[start - 1] if start else ""
            head = text[line_start:start].strip() if (first.isdigit() or first.isspace()) and (last.isdigit() or last.isspace()) else ""
            # The number that opens a claim or list item.
            if head.isdigit() and len(head) <= 4 and not text[start:end].strip(".．"):
                if not last_claim or int(head) == 1:
                    last_claim = int(head)
                out.append(Gap(end, nxt, 0, "", "", False, "number"))
                continue
        left, near = _left(text, start, end, kind, breaks, out)
        # A single letter whose stop the next word touches: initials.
        if kind == "stop" and nxt == end and text[start] == "." and fixed is None and (start == 1 or not text[start - 2].isalnum() and "\u0900" > text[start - 1]):
            fixed = 0
        out.append(Gap(end, nxt, fixed, left, right, near, kind))
    if not out or out[-1].kind != "end":
        end = len(text.rstrip())
        out.append(Gap(end, n, 1, "", "", False, "end"))
    return out


def _thai_line(line: str, text: str, nxt: int) -> bool:
    return "\u0e00" <= text[nxt] <= "\u0e7f" or _THAI_SIGN.search(line) is not None


def _line(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[at : end if end >= 0 else len(text)].strip()


def _capitals(line: str) -> bool:
    return line.isupper() and sum(map(str.isalpha, line)) > 3


def _heading(text: str, line: str, nxt: int, kind: str) -> bool:
    """Whether a line break has a heading in capitals on one side; lines in capitals on both are a text in capitals."""
    here, there = _capitals(line), _capitals(after := _line(text, nxt))
    title = after if there else line
    return here != there and (there or kind == "line") and title[-1] not in ".,;"


def _left(text: str, start: int, end: int, kind: str, breaks: int, out: list[Gap]) -> tuple[str, bool]:
    """Key of what precedes a gap, and whether the gap before lies only one word back."""
    # A word counts by its last ``WORD_END`` characters.
    lowest = max(0, start - WORD_END, out[-1].next if out and out[-1].next == out[-1].end and out[-1].kind == "stop" and out[-1].fixed is None and len(out[-1].left) > 4 else 0)
    a = text.rfind(" ", lowest, start) + 1 or lowest
    a = text.rfind("\n", a, start) + 1 or a
    word = text[a:start]
    if not word.isalnum() and _CUT.search(word):
        cut = max(map(word.rfind, _CUTS)) + 1
        a += cut
        word = word[cut:]
    near = bool(out) and out[-1].next >= a and out[-1].kind != "span"
    if kind == "line":
        return "\n" + (_DIGITS.sub("9", word[-1:]) if word and "぀" <= word[-1] <= "鿿" else _DIGITS.sub("9", word)), near
    stop = text[start]
    tail = text[start:end]
    closed = '"' if len(tail) > 1 and any(c in _CLOSE_SET for c in tail) else ""
    how = "\n" if breaks else "" if end < len(text) and text[end].isspace() else "\0"
    if stop not in ".．" or start + 1 < end and text[start + 1] in ".．":
        sign = "…" if stop in "…" or stop in ".．" else stop
        return sign + closed + how, near
    if not word and start and text[start - 1].isspace():
        # A lone point, as in formulas.
        return "._" + closed + how, near
    if word and ("぀" <= word[-1] <= "鿿" or word[-1] in "）】》」』％" or how == "\0" and "぀" <= text[end : end + 1] <= "鿿"):
        return ".cjk" + closed + how, near
    key = word.lower().rpartition("'")[2]
    if key[-1:].isdigit() or (len(key) == 1 and key.isalpha()):
        before = text[lowest:a].split()
        key = (before[-1].lower() if before else "") + " " + ("9" if key[-1:].isdigit() else key)
    return "." + (key if key.isalpha() else _DIGITS.sub("9", key)) + closed + how, near


def _left_back(left: str) -> str:
    """Class of a left key that the model has not met often enough."""
    if left[:1] == "\n":
        return "\n" + _shape(left[1:])
    if left[:1] != "." or left.startswith((".cjk", "._")):
        return left
    core = left[1:].rstrip("\n\0").rstrip('"')
    flags = left[1 + len(core) :]
    if " " in core:
        return ".<9>" + flags if core.endswith("9") else ".<x>" + flags
    if core in ABBREVIATIONS:
        return ".<abbr>" + flags
    return f".<{min(len(core), 4)}{'.' if '.' in core else ''}>" + flags


class Model:
    """Weights of left and right n-grams; scores are log odds of a boundary."""

    def __init__(self) -> None:
        self.left: dict[str, float] = {}
        self.left_class: dict[str, float] = {}
        self.right: dict[str, float] = {}
        self.right_class: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], float] = {}

    def left_odds(self, key: str) -> float:
        if '"' not in key and (key[:1] in _PURE_STOPS and key or key.startswith(".cjk")):
            return SURE
        w = self.left.get(key)
        if w is None:
            w = self.left_class.get(_left_back(key))
        return _prior(key) if w is None else w

    def right_odds(self, key: str) -> float:
        w = self.right.get(key)
        if w is None:
            w = self.right_class.get(_shape(key), 0.0)
        return w

    def odds(self, g: Gap) -> float:
        return self.pair_odds(g.left, g.right)

    def pair_odds(self, left: str, right: str) -> float:
        known = self.pairs.get((left, right))
        if known is None:
            # Behind a lone point only a word known to begin sentences counts.
            r = self.right.get(right, PLAIN_RIGHT) if left.startswith("._") else self.right_odds(right)
            known = self.pairs[(left, right)] = self.left_odds(left) + (max(r, PLAIN_RIGHT) if r < PLAIN_RIGHT and _plain(left) else r)
            if len(self.pairs) > 200_000:
                self.pairs.clear()
        return known

    def posteriors(self, found: list[Gap]) -> list[float]:
        """Posterior of each event of a text: forward and backward over the chain of events.

        An event's weight depends on the one before only where a single word lies between (a sentence of one word): there
        it loses ``NEAR``. Chains of such neighbours are solved exactly, all other events on their own.
        """
        out = [0.0] * len(found)
        i, n = 0, len(found)
        odds = [40.0 if g.fixed == 1 else -40.0 if g.fixed == 0 else self.odds(g) for g in found]
        while i < n:
            j = i + 1
            while j < n and found[j].near:
                j += 1
            if j == i + 1:
                out[i] = _sigmoid(odds[i])
            else:
                self._chain(odds, i, j, out)
            i = j
        return out

    @staticmethod
    def _chain(odds: list[float], i: int, j: int, out: list[float]) -> None:
        weight = [(1.0, math.exp(max(-40.0, min(40.0, o)))) for o in odds[i:j]]
        near = math.exp(-NEAR)
        forward = [weight[0]]
        for w0, w1 in weight[1:]:
            a, b = forward[-1]
            x, y = w0 * (a + b), w1 * (a + b * near)
            forward.append((x / (x + y), y / (x + y)))
        back = (1.0, 1.0)
        for k in range(j - i - 1, -1, -1):
            a, b = forward[k][0] * back[0], forward[k][1] * back[1]
            out[i + k] = b / (a + b)
            w0, w1 = weight[k]
            x, y = w0 * back[0] + w1 * back[1], w0 * back[0] + w1 * near * back[1]
            back = (x / (x + y), y / (x + y))


#: Log odds of a boundary that an abbreviation that rarely ends a sentence has at most.
ABBREVIATION_ODDS = -3.0
#: Log odds of a sign that is nothing but a full stop.
SURE = 12.0
#: Least and largest log odds that the word to the right can bring, and the least behind an ordinary word.
RIGHT_ODDS = (-8.0, 6.0)
PLAIN_RIGHT = -2.5
#: What a boundary loses if only one word lies between it and the boundary before.
NEAR = 4.0


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _abbreviated(core: str) -> bool:
    """Whether a left key without its flags is a listed abbreviation or a single letter; behind a number that is a unit."""
    before, _, word = core.rpartition(" ")
    return (word in ABBREVIATIONS or len(word) == 1 and word.isalpha()) and before[-1:] != "9"


def _plain(key: str) -> bool:
    """Whether a left key is an ordinary word with its stop, behind which any word may begin a sentence."""
    core = key[1:].rstrip("\n\0")
    return key[:1] == "." and len(core) > 3 and core.isalpha() and core not in ABBREVIATIONS and core not in _OPEN or '"' not in key and (key[:1] in _PURE_STOPS + "?!" or key.startswith(".cjk"))


def _prior(key: str) -> float:
    """Log odds that a left key brings before any count."""
    if key[:1] == "\n":
        return -1.0
    if key[:1] == "…":
        return -2.0
    if key[:1] != ".":
        return 4.0 if '"' not in key else -1.5
    if key.startswith(".cjk"):
        return 3.0 if '"' not in key else -1.5
    core = key[1:].rstrip("\n\0").rstrip('"')
    closed = '"' in key
    if core.replace(" ", "") in _OPEN:
        return 0.0
    if _abbreviated(core):
        return -4.0
    if " " in core:
        return 0.5
    if len(core) <= 1 or "." in core or len(core) == 2 and key.endswith("\0"):
        return 1.0 if closed else -1.5
    return 1.0 if closed else 2.5


class Counts(NamedTuple):
    """N-gram counts of texts: words that begin sentences, words in running text, hidden events, what ends paragraphs.

    ``others`` are words of running text by class, for those that are in no event. While texts are tallied it holds what
    stands between white space, whose words ``_keyed`` adds to those of ``running``.
    """

    begin: Counter[str]
    running: Counter[str]
    hidden: Counter[tuple[str, str]]
    ends: Counter[str]
    others: Counter[str]


def _key(raw: str) -> str:
    """Key of a word of running text, as ``_right`` gives it at the word's place."""
    if raw[0] in _OPENING:
        return raw[0] + _shape(raw[1:])
    return _DIGITS.sub("9", raw)


def _tally(text: str, here: list[Gap], counts: Counts) -> None:
    """Adds a text with its gaps to the counts; words of running text as they stand, see ``_key``."""
    if text.strip():
        counts.begin[_right(text, len(text) - len(text.lstrip()))] += 1
    for g in here:
        if g.fixed == 1 and g.right and g.kind != "thai":
            counts.begin[g.right] += 1
            if g.left:
                counts.ends[g.left] += 1
        elif g.fixed is None:
            counts.hidden[(g.left, g.right)] += 1
    # No word reaches over white space. What stands between it recurs, but not in scripts without spaces.
    runs = text.split()
    if len(text) < TOKEN * len(runs):
        counts.others.update(runs)
    else:
        counts.running.update(_RUNNING.findall(text))
    counts.running.subtract([m.group(1) for at in _starts(text, here) if (m := _RUNNING.match(text, at))])


def _starts(text: str, here: list[Gap]) -> Iterator[int]:
    """The next places of gaps at which no word of running text from before goes on: one that begins with a letter ends at white space only."""
    seen, inside, last = 0, False, -1
    for g in here:
        at = g.next
        if at == last:
            continue
        last = at
        if at and not text[at - 1].isspace():
            *before, run = text[seen:at].rsplit(None, 1)
            inside = inside and not before and not text[seen].isspace() or _LETTER.search(run) is not None
            seen = at
            if inside:
                continue
        yield at


def _keyed(counts: Counts) -> Counter[str]:
    """The words of running text of tallied texts by key; empties what they were held in."""
    out: Counter[str] = Counter()
    for raw, n in counts.running.items():
        if n:
            out[_key(raw)] += n
    for run, n in counts.others.items():
        for raw in _RUNNING.findall(run):
            out[_key(raw)] += n
    counts.running.clear()
    counts.others.clear()
    return Counter({k: n for k, n in out.items() if n})


def train(texts: list[str], rounds: int = EM_ROUNDS) -> Model:
    """A model from unlabelled texts."""
    counts = Counts(Counter(), Counter(), Counter(), Counter(), Counter())
    for text in texts:
        _tally(text, gaps(text), counts)
    return fit(counts._replace(running=_keyed(counts)), rounds)


def fit(counts: Counts, rounds: int = EM_ROUNDS) -> Model:
    """A model from counts, by expectation maximisation."""
    begin, running, hidden, ends, others = counts
    model = Model()
    keys = {r for _, r in hidden} | set(begin)
    post: dict[tuple[str, str], float] = {}
    # Running text is far more than what follows stops: it weighs as much as what begins sentences.
    scale = min(1.0, (sum(begin.values()) + sum(hidden.values()) / 2) / max(sum(running.values()) + sum(others.values()), 1))
    for step in range(rounds + 1):
        first, mid = Counter({k: float(v) for k, v in begin.items()}), Counter({k: v * scale for k, v in running.items()})
        yes: dict[str, float] = defaultdict(float)
        no: dict[str, float] = defaultdict(float)
        for (left, right), n in hidden.items():
            # The first round knows only what begins paragraphs and what stands in running text.
            p = post.get((left, right), 0.0)
            if step:
                first[right] += n * p
                mid[right] += n * (1 - p)
            yes[left] += n * p
            no[left] += n * (1 - p)
        for left, n in ends.items():
            if left[:1] != "\n":
                yes[left] += n
        # Words to the right: relative frequency after events against that in running text, classes for rare ones.
        total_first, total_mid = sum(first.values()), sum(mid.values()) + sum(others.values()) * scale
        class_first, class_mid = Counter(), Counter()
        for k in keys | set(running):
            class_first[_shape(k)] += first[k]
            class_mid[_shape(k)] += mid[k]
        for c, n in others.items():
            class_mid[c] += n * scale
        model.right_class = {s: math.log((class_first[s] + 0.5) / (total_first + 1)) - math.log((class_mid[s] + 0.5) / (total_mid + 1)) for s in {*class_first, *class_mid}}
        model.right = {}
        for k in keys:
            if first[k] + mid[k] >= 3:
                s = _shape(k)
                back = math.exp(model.right_class[s])
                a, b = first[k] / (total_first + 1), mid[k] / (total_mid + 1)
                unit = 2.0 / (total_first + total_mid)
                model.right[k] = max(RIGHT_ODDS[0], min(RIGHT_ODDS[1], math.log((a + unit * back) / (b + unit))))
        if not step:
            post = {(left, right): _sigmoid(_prior(left) + max(model.right_odds(right), PLAIN_RIGHT if _plain(left) else -8.0)) for left, right in hidden}
            continue
        by_class_yes, by_class_no = defaultdict(float), defaultdict(float)
        for left in {*yes, *no}:
            c = _left_back(left)
            by_class_yes[c] += yes[left]
            by_class_no[c] += no[left]
        model.left_class = {c: max(-6.0, min(6.0, math.log((by_class_yes[c] + 1.0) / (by_class_no[c] + 1.0)))) for c in by_class_yes}
        model.left = {}
        for left in {*yes, *no}:
            # Words alike share their counts; known abbreviations and signs keep their own prior.
            own = _prior(left)
            prior = _sigmoid(model.left_class[_left_back(left)] if own > 1 and left[:1] == "." else own)
            most = 7.0 if own > -4 else ABBREVIATION_ODDS
            model.left[left] = max(-7.0, min(most, math.log((yes[left] + 6 * prior) / (no[left] + 6 * (1 - prior)))))
        model.left = {k: v for k, v in model.left.items() if yes[k] + no[k] >= 3}
        model.pairs.clear()
        post = {(left, right): _sigmoid(model.pair_odds(left, right)) for left, right in hidden}
    model.pairs.clear()
    return model


def split(text: str | None, model: Model) -> tuple[list[int], list[int]]:
    """Start and end of each sentence of a text, in code points, without surrounding white space. An empty or null text has none."""
    starts: list[int] = []
    ends: list[int] = []
    if not text or text.isspace():
        return starts, ends
    found = gaps(text)
    at = len(text) - len(text.lstrip())
    for g, p in zip(found, model.posteriors(found), strict=True):
        if p > 0.5 and g.end > at:
            starts.append(at)
            ends.append(g.end)
            at = g.next
    return starts, ends


def sentences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start_pos, end_pos) of the sentences of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 512):
                found = [split(t, model) for t in texts[low : low + 512]]
                count = np.array([len(s) for s, _ in found], np.int64)
                ids = batch.column(0).slice(low, len(found)).take(pa.array(np.repeat(np.arange(len(found)), count)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for s, _ in found for x in s], pa.int32()), pa.array([x for _, e in found for x in e], pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")


#: Rows of ``scanned``: the gaps of a document (``kind`` null), or a count of a part of the documents.
SCANNED = "doc_id bigint, at int, ends array<int>, nexts array<int>, fixed array<tinyint>, near array<boolean>, pairs array<string>, kind int, left string, right string, n bigint"
BEGIN, ENDS, HIDDEN, RUNNING = range(4)
#: Keys that a task holds before it passes their counts on.
HELD_KEYS = 200_000


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over all documents (doc_id, text), whole: the gaps of each and the n-gram counts of all, as rows of ``SCANNED``.

    Of a hidden event ``pairs`` holds its left and right key with a unit separator between; no right key has one.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(SCANNED))
    names = ["doc_id", "at", "ends", "nexts", "fixed", "near", "pairs"], ["kind", "left", "right", "n"]

    def table(columns: dict[str, list]) -> list[pa.RecordBatch]:
        size = len(next(iter(columns.values())))
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds]
        return [pa.RecordBatch.from_arrays(arrays, schema=kinds)] if size else []

    def passed(counts: Counts) -> list[pa.RecordBatch]:
        rows = [(BEGIN, None, k, n) for k, n in counts.begin.items()] + [(ENDS, k, None, n) for k, n in counts.ends.items()]
        rows += [(HIDDEN, a, b, n) for (a, b), n in counts.hidden.items()] + [(RUNNING, _shape(k), k, n) for k, n in _keyed(counts).items()]
        for c in counts:
            c.clear()
        return table(dict(zip(names[1], map(list, zip(*rows, strict=True)), strict=True))) if rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Counter(), Counter(), Counter(), Counter(), Counter())
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = []
                for doc, text in zip(batch.column(0).slice(low, 512).to_pylist(), batch.column(1).slice(low, 512).to_pylist(), strict=True):
                    if not text or text.isspace():
                        continue
                    here = gaps(text)
                    _tally(text, here, counts)
                    rows.append((doc, len(text) - len(text.lstrip()), [g.end for g in here], [g.next for g in here], [-1 if g.fixed is None else g.fixed for g in here], [g.near for g in here], [f"{g.left}\x1f{g.right}" if g.fixed is None else "" for g in here]))
                    if sum(map(len, counts)) > HELD_KEYS:
                        yield from passed(counts)
                if rows:
                    yield from table(dict(zip(names[0], map(list, zip(*rows, strict=True)), strict=True)))
        yield from passed(counts)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCANNED)


def corpus_counts(scan: DataFrame) -> Counts:
    """The counts of all documents. Words of running text that are in no event reach the driver by class only."""
    rows = scan.filter("kind is not null").groupBy("kind", "left", "right").agg(F.sum("n").alias("n"))
    begin, running, hidden, ends, others = Counts(Counter(), Counter(), Counter(), Counter(), Counter())
    for r in sorted(rows.filter(F.col("kind").isin(ENDS, HIDDEN)).collect(), key=lambda r: (r.kind, r.left, r.right or "")):
        if r.kind == ENDS:
            ends[r.left] = r.n
        else:
            hidden[(r.left, r.right)] = r.n
    known = F.count_if(F.col("kind") != RUNNING) > 0
    words = rows.filter(F.col("kind") != ENDS).groupBy("right").agg(
        F.when(~known, F.max(F.when(F.col("kind") == RUNNING, F.col("left")))).alias("shape"),
        F.coalesce(F.sum(F.when(F.col("kind") == BEGIN, F.col("n"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col("kind") == RUNNING, F.col("n"))), F.lit(0)).alias("r"),
    )
    words = words.groupBy("shape", F.when(F.col("shape").isNull(), F.col("right")).alias("word")).agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    for r in sorted(words.collect(), key=lambda r: (r.shape or "", r.word or "")):
        if r.shape is not None:
            others[r.shape] = r.r
            continue
        if r.b:
            begin[r.word] = r.b
        if r.r:
            running[r.word] = r.r
    return Counts(begin, running, hidden, ends, others)


def scanned_sentences(scan: DataFrame, model: Model) -> DataFrame:
    """``sentences`` from the gaps that ``scanned`` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, nexts, fixed, near, pairs = (batch.column(k).flatten() for k in range(2, 7))
            ends, nexts, near = ends.to_numpy(), nexts.to_numpy(), near.to_numpy(zero_copy_only=False)
            own = pairs.dictionary_encode()
            odds = np.array([model.pair_odds(*p.rsplit("\x1f", 1)) if p else 0.0 for p in own.dictionary.to_pylist()] or [0.0])[own.indices.to_numpy()]
            fixed = fixed.to_numpy()
            odds = np.where(fixed == 1, 40.0, np.where(fixed == 0, -40.0, odds))
            post = 1 / (1 + np.exp(-np.clip(odds, -40.0, 40.0)))
            size = np.array([len(x) for x in batch.column(2)], np.int64)
            low = np.concatenate([[0], np.cumsum(size)])
            first = ~near
            first[low[:-1]] = True
            heads = np.flatnonzero(first)
            tails = np.append(heads[1:], len(first))
            for i, j in zip(heads[tails - heads > 1].tolist(), tails[tails - heads > 1].tolist(), strict=True):
                out = [0.0] * (j - i)
                model._chain(odds[i:j].tolist(), 0, j - i, out)
                post[i:j] = out
            chosen = np.flatnonzero(post > 0.5)
            parts = np.searchsorted(chosen, low)
            e, x = ends[chosen].tolist(), nexts[chosen].tolist()
            count, starts, stops = [], [], []
            for d, at in enumerate(batch.column(1).to_pylist()):
                before = len(starts)
                for k in range(parts[d], parts[d + 1]):
                    if e[k] > at:
                        starts.append(at)
                        stops.append(e[k])
                        at = x[k]
                count.append(len(starts) - before)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    found = scan.filter("kind is null").select("doc_id", "at", "ends", "nexts", "fixed", "near", "pairs")
    return found.mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = materialize(scanned(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return scanned_sentences(scan, fit(corpus_counts(scan)))
