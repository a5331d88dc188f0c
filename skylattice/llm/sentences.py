"""Sentence units across languages and scripts.

Every run of terminators is held against the standard rules on the character property Sentence_Break, in their order
(SB6 to SB11), with these tailorings, each a function of its own: abbreviations of the languages at hand end nothing;
what stands in quotation marks or brackets ends nothing before they close; an exclamation or question mark before a
small letter ends nothing; some terminators stand without a space after them; scripts that write no terminator (Thai)
end sentences at spaces. Layout comes first: blank lines, headings, list items and log lines bound units; a single line
break in running text is a space.

Languages in Latin script are told by their function words, block by block, else by those of the whole text, else by its
label; abbreviations count only in their language. All work is linear in the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.encoding import portions, spread
from skylattice.llm.languages import LONGEST, Abbreviations, abbreviations, detect, language_of

#: How a sentence goes on after a closed quotation, in scripts without capitals.
GOES_ON = (
    "と って という などと 然后 然後 接着 接著 随后 隨後 于是 但 而 并 並 便 的 और फिर तो लेकिन व तथा कहा कहकर "
    "ثم و ف لكن بل اور پھر لیکن کہا کہہ 라고 이라고 하고 라며 고 แล้ว และ"
).split()

_NEWLINE = r"(?>\r\n|[\n\r\x0b\x0c\x85\u2028])"
_BLANK = regex.compile(rf"(?:{_NEWLINE}[^\S\n\r\x0b\x0c\x85\u2028\u2029]*){{2,}}|\u2029")
_LINE = regex.compile(_NEWLINE)
_LOG = regex.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\](?=\s)|\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[.,\d]*\s+\[?[A-Z]{4,}")
_MARK = regex.compile(r"\s*(?:[-*+•‣▪◦–]|\[[ xX✓✗]?\]|☐|☑)\s+(?=\S)")
_NUMBER = regex.compile(r"\s*\(?(\d{1,4})[.)]\s+(?=\S)")
_HASH = regex.compile(r"\s*#{1,6}\s")
_TERM = r"[\p{SB=STerm}\p{SB=ATerm}…‥;\u037e]"
#: A run of terminators. A full stop right before a digit (SB6) or a small letter (SB8) is passed over at once.
_CANDIDATE = regex.compile(rf"(?!\.[0-9a-z]){_TERM}+")
_SPACE_END = regex.compile(r"(?<=\S)\s+(?=\S)")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_OPENS_WORD = frozenset("([{\"“„«»”「『（")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "«": "»", "‹": "›"}
_CLOSERS = frozenset(")]}）］】」』》〉”»›\"’'“")
_QUOTE_ENDS = frozenset("」』”»›\"“")
_CONTINUES = frozenset(",:;-–—‒，、：；،؛・·")


@lru_cache(maxsize=65536)
def _lower(c: str) -> bool:
    return c.islower()


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or o >= 0x20000:
        return "cjk"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if c.isupper() or c.islower() or c.istitle():
        return "cased"
    return "other" if c.isalpha() else "sign"


def _word_before(text: str, begin: int, end: int) -> str:
    """What stands before a position without a space or opening mark, no more of it than the longest abbreviation and its tail.

    Nothing is lost by that: longer words are in no table, and a longer chain of initials or digits is one by its end too.
    """
    at, low = end, max(begin, end - 2 * LONGEST)
    while at > low and not text[at - 1].isspace() and text[at - 1] not in _OPENS_WORD:
        at -= 1
    return text[at:end]


_MARKS = regex.compile(r"[\"()\[\]{}（）［］【】「」『』《》〈〉“”„«»‹›]")


def _enclosures(text: str, begin: int, end: int) -> tuple[list[tuple[int, int]], set[int]]:
    """(outermost spans in quotation marks or brackets, positions of all closing marks) of a segment; what never closes is no span."""
    spans: list[tuple[int, int]] = []
    closing: set[int] = set()
    stack: list[tuple[str, int]] = []
    waits: dict[str, int] = {}  # how many open marks wait for each closing one
    for m in _MARKS.finditer(text, begin, end):
        c, i = m[0], m.start()
        if waits.get(c):
            while True:
                want, start = stack.pop()
                waits[want] -= 1
                if want == c:
                    break
            closing.add(i)
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, i))
        elif (want := "“" if c == "„" else '"' if c == '"' else _PAIRS.get(c)) is not None:
            stack.append((want, i))
            waits[want] = waits.get(want, 0) + 1
    return spans, closing


_COUNTED = regex.compile(r"[\d.,٫:/±~≥<>$-]*\d")
_TAIL = regex.compile(r"[-’'/\u200b-\u200d\ufeff]")
_INITIALS = regex.compile(r"\.?\p{Lu}(?:\.\p{Lu})+")
_SHOUTED = regex.compile(r"\p{Lu}{2,}\s+\p{Ll}")
#: Not by regex, which would look for the underscore in all the rest of the text first.
_CODE = re.compile(r"[^\W\d_][\w/-]*_[^\s.]*[.,]*(?=\s|$)")
_GOES_ON = re.compile("|".join(sorted(map(re.escape, GOES_ON), key=len, reverse=True)))
_GOES_ON_WHOLE = re.compile(rf"(?:{_GOES_ON.pattern})(?=\s|$)|라고|이라고|라며")
_STRONG = frozenset("!?;")
_FULL_STOPS = frozenset(".․﹒．…‥")


class _Context:
    """A text and the languages of the block at hand."""

    def __init__(self, text: str, label: str | None) -> None:
        self.text, self.label = text, language_of(label)
        self.begin = self.end = 0
        self._whole: tuple[str, ...] | None = None
        self._block: Abbreviations | None = None

    def enter(self, begin: int, end: int) -> None:
        """Take up a block."""
        self.begin, self.end, self._block = begin, end, None

    @property
    def words(self) -> Abbreviations:
        """Abbreviations of the block's languages, or the text's, or the label's."""
        if self._block is None:
            found = detect(self.text[self.begin : self.end], self.label)
            if not found:
                if self._whole is None:
                    self._whole = detect(self.text, self.label) or ((self.label,) if self.label else ())
                found = self._whole
            self._block = abbreviations(found)
        return self._block


def _abbreviated(x: _Context, begin: int, dot: int, s: int) -> bool:
    """Whether the full stop at ``dot`` belongs to an abbreviation, initial or ordinal, given what follows at ``s``."""
    text = x.text
    raw = _word_before(text, begin, dot)
    size = len(raw)
    raw = unicodedata.normalize("NFC", raw)
    word = raw.lower()
    if not word:
        return False
    before = text[max(begin, dot - size - 2 * LONGEST) : dot - size].split()  # a longer word before is in no table
    written = unicodedata.normalize("NFC", before[-1]).strip("(（\"“„«") if before else ""
    prev = written.lower()
    known = x.words
    counted = bool(_COUNTED.fullmatch(prev))
    capital = _capitalised(text, s)
    if _INITIALS.fullmatch(raw):
        return True
    if len(raw) == 1 and raw.isalpha():
        if prev.endswith(".") and word in known.two_part.get(prev[:-1].rsplit(".", 1)[-1], ""):
            return not capital or word == "b"
        if raw.isupper():
            return not counted and not _named_by_letter(known, written, len(before) > 1) and text[s].isalpha()
    if counted and len(word) <= 2:
        return False
    tail = _TAIL.split(word)[-1]
    if word in known.always or tail in known.always:
        return True
    if word in known.before_number or tail in known.before_number:
        return not capital
    return word.isdigit() and len(word) <= 2 and prev in known.ordinal


def _named_by_letter(known: Abbreviations, written: str, inside: bool) -> bool:
    """Whether a single capital names the thing before it (section B, Dock B) rather than being an initial.

    A capitalised word inside a sentence is taken for such a thing; a title or another initial ends in a full stop.
    """
    return written.lower() in known.named or inside and len(written) > 1 and written[0].isupper() and written[1:].islower() and written.isalpha()


def _ends(x: _Context, begin: int, end: int, a: int, b: int, j: int, script: str) -> bool:
    """Whether the terminators at [a, b), closed up to j, end a unit: the standard rules in order, tailored as marked.

    ``script`` is that of the last letter before ``a``.
    """
    text = x.text
    s = j
    while s < end and text[s].isspace():
        s += 1
    if s >= end:  # SB2: the end of the text ends it anyway
        return False
    terms, nxt, spaced = text[a:b], text[s], s > j
    stops = all(c in _FULL_STOPS for c in terms)  # ATerm, else STerm
    kind, small = _script(nxt), _lower(nxt)
    last = text[a - 1 : a]
    if (";" in terms or "\u037e" in terms) and script != "greek":  # tailored: a terminator in Greek only
        return False
    if stops and len(terms) == 1 and terms not in "…‥" and b == s and (nxt.isdigit() or not last):  # SB6
        return False
    if small and (stops or b < j or spaced and terms != ";") and not _CODE.match(text, s, end):  # SB8; tailored: STerm too, an identifier may begin a sentence
        return False
    if nxt in _CONTINUES and not (nxt == "-" and spaced and not text[s + 1 : s + 2].isspace()):  # SB8a; tailored: "-x" is a word
        return False
    if b < j:  # SB9: what closes belongs to the unit
        return _ends_quotation(x, s, end, terms, text[b:j], spaced, kind) if any(c in _QUOTE_ENDS for c in text[b:j]) else True
    if not stops:
        return spaced or not all(c in _STRONG for c in terms if c not in _FULL_STOPS) or _ends_unspaced_strong(x, a, s, kind)
    if len(terms) > 1 or terms in "…‥":  # tailored: an ellipsis before a space, a capital or another script's letter
        return spaced or kind in ("cjk", "other") or _script(last or " ") == "cjk" or nxt.isupper() or nxt in "（「『“《"
    if not spaced:
        return _ends_unspaced_stop(x, begin, a, s, kind)  # SB7 and SB11 without a space
    return not _abbreviated(x, begin, a, s)  # SB11, tailored by abbreviations


def _ends_quotation(x: _Context, s: int, end: int, terms: str, closed: str, spaced: bool, kind: str) -> bool:
    """Tailored: a closed quotation is part of its sentence if this goes on."""
    nxt = x.text[s]
    if not spaced and kind != "cjk" and (nxt.isalpha() or nxt.isdigit()) and all(c in ".!?…" for c in terms):
        return False
    if kind == "cjk":
        return not _GOES_ON.match(x.text, s, end)
    return not (kind == "other" and _GOES_ON_WHOLE.match(x.text, s, end))


def _ends_unspaced_strong(x: _Context, a: int, s: int, kind: str) -> bool:
    """Tailored: "!" or "?" without a space ends before a capitalised word or an opening mark, and in scripts without case."""
    if kind not in ("cased", "sign"):
        return True
    return _capitalised(x.text, s) or x.text[s] in "\"“«„(（¿¡「『" and x.text[a - 1 : a].isalpha()


def _ends_unspaced_stop(x: _Context, begin: int, a: int, s: int, kind: str) -> bool:
    """Tailored: a full stop without a space ends before a capitalised word, if what is before is no short word."""
    text, nxt, last = x.text, x.text[s], x.text[a - 1 : a]
    if kind not in ("cased", "greek") and nxt not in "\"“«„(":
        return kind in ("other", "cjk") and _script(last) == kind and len(_word_before(text, begin, a)) > 2
    word = _word_before(text, begin, a)
    unit = len(word) <= 2 and text[max(begin, a - len(word) - 10) : a - len(word)].rstrip()[-1:].isdigit()
    shouted = (unit or word.isalpha() and len(word) > 2) and _SHOUTED.match(text, s)
    ok = (_capitalised(text, s) or shouted or nxt.isupper() and text[s + 1 : s + 2].isspace()) and (last.islower() or last.isdigit() or last in ")°%") or nxt in "\"“«„(" and len(word) > 2
    return bool(ok) and (len(word) != 1 or unit or last == "%") and not _abbreviated(x, begin, a, s)


def _capitalised(text: str, s: int) -> bool:
    """Whether a capital and then a small letter follow, combining marks aside."""
    if not text[s].isupper():
        return False
    rest = next((c for c in text[s + 1 : s + 4] if not unicodedata.combining(c)), "")
    return rest.islower()


_ENUMERATED = regex.compile(r"\p{Lu}|\d{1,3}|[IVXLC]+")


def _terminated(x: _Context, begin: int, end: int, title: bool, spans: list[tuple[int, int]], closing: set[int]) -> list[int]:
    """Where terminators end units."""
    text, cuts, k = x.text, [], 0
    seen, script = begin, ""  # the script of the last letter so far: every character is looked at once
    for m in _CANDIDATE.finditer(text, begin, end):
        a, b = m.span()
        if text[a] in ";\u037e":
            letter = next((c for c in reversed(text[seen:a]) if c.isalpha()), "")
            script, seen = _script(letter) if letter else script, a
        j = b
        while j < end:
            c = text[j]
            if j in closing or c in "’'" and j + 1 < end and not text[j + 1].isalpha():
                j += 1
            elif c.isspace() and closing:  # French sets a space before the closing mark, and some before a terminator
                t = j
                while t < end and text[t].isspace():
                    t += 1
                if t < end and t in closing and text[t] in "»›":
                    j = t + 1
                else:
                    break
            else:
                break
        while k < len(spans) and spans[k][1] < j:
            k += 1
        if k < len(spans) and spans[k][0] < j <= spans[k][1]:  # tailored: nothing ends inside quotation marks or brackets
            continue
        if title and text[a:b] == "." and _ENUMERATED.fullmatch(_word_before(text, begin, a)):
            continue
        if _ends(x, cuts[-1] if cuts else begin, end, a, b, j, script):
            cuts.append(j)
    return cuts


def _at_spaces(text: str, begin: int, end: int, spans: list[tuple[int, int]]) -> list[int]:
    """Where spaces end units of a script that writes no terminators."""
    gaps = [m.span() for m in _SPACE_END.finditer(text, begin, end)]
    cuts, k = [], 0
    for i, (a, b) in enumerate(gaps):
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if k < len(spans) and spans[k][0] < a:
            continue
        left = text[gaps[i - 1][1] if i else begin : a]
        right = text[b : gaps[i + 1][0] if i + 1 < len(gaps) else end]
        if not _THAI.search(left) or left[-1] in "ๆฯ" or left[-1] in _CONTINUES or right[0] in _CONTINUES:
            continue
        if _THAI.search(right):
            if len(left) >= 8:
                cuts.append(a)
        else:
            after = text[gaps[i + 1][1] : gaps[i + 2][0] if i + 2 < len(gaps) else end] if i + 1 < len(gaps) else ""
            if not after or not _THAI.search(after) or _TERM_AT_END.search(right):
                cuts.append(a)
    return cuts


def _split_run(x: _Context, begin: int, end: int, title: bool) -> list[tuple[int, int]]:
    text = x.text
    spans, closing = _enclosures(text, begin, end)
    cuts = _terminated(x, begin, end, title, spans, closing)
    if _THAI.search(text, begin, end):
        cuts += _at_spaces(text, begin, end, spans)
    out, start = [], begin
    for c in [*sorted(set(cuts)), end]:
        lo, hi = start, c
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
        start = c
    return out


_TERM_AT_END = regex.compile(_TERM + "$")
_CLOSED_END = regex.compile(_TERM + r"[\p{SB=Close}]*$")
_STRONG_TERM = regex.compile(r"[\p{SB=STerm}…]")


def _title(line: str) -> bool:
    """Whether a block of one line reads as a heading: few words and no terminator at its end."""
    return len(line) <= 80 and 0 < len(line.split()) <= 8 and not _CLOSED_END.search(line.rstrip()) and not _STRONG_TERM.search(line)


def sentence_units(text: str | None, label: str | None = None) -> list[tuple[int, int]]:
    """Units of a text as code-point offsets, end exclusive, white space trimmed. Null, empty and blank texts have none.

    ``label`` names the text's language; it counts only where the text doesn't tell.
    """
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    x, begin = _Context(text, label), 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        if stop > begin and not text[begin:stop].isspace():
            x.enter(begin, stop)
            out += _block(x, begin, stop)
        begin = m.end() if m else stop
    return out


def _block(x: _Context, begin: int, end: int) -> list[tuple[int, int]]:
    text, lines, at = x.text, [], begin
    for m in _LINE.finditer(text, begin, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    lines = [(a, b) for a, b in lines if not text[a:b].isspace() and a < b]
    segments: list[list] = []  # [begin, end, whole]
    number = None
    for i, (a, b) in enumerate(lines):
        if text[a].isalpha():  # neither a log line, a heading's mark nor a list's
            if not segments or segments[-1][2]:
                segments.append([a, b, False])
            else:
                segments[-1][1] = b
            continue
        if _LOG.match(text, a, b) or _HASH.match(text, a, b):
            segments.append([a, b, True])
            number = None
            continue
        item = bool(_MARK.match(text, a, b))
        if not item and (n := _NUMBER.match(text, a, b)):
            value = int(n[1])
            item = i == 0 or segments[-1][2] or (number is not None and value in (number + 1, 1, number))
            if item:
                number = value
        if item or not segments or segments[-1][2]:
            segments.append([a, b, False])
        else:
            segments[-1][1] = b
    out: list[tuple[int, int]] = []
    for a, b, whole in segments:
        if whole:
            while text[a].isspace():
                a += 1
            while text[b - 1].isspace():
                b -= 1
            out.append((a, b))
            continue
        mark = None if text[a].isalpha() else _MARK.match(text, a, b) or _NUMBER.match(text, a, b)
        skip = mark.end() if mark else a
        parts = _split_run(x, skip, b, len(lines) == 1 and not mark and _title(text[a:b]))
        if mark and parts:
            first = a
            while text[first].isspace():
                first += 1
            parts[0] = (first, parts[0][1])
        out += parts
    return out


def split_sentences(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per sentence unit: ``doc_id, sent_start, sent_end`` (and ``sentence``).

    Whole texts are processed, whatever their length. Null, empty and blank texts give no rows; repeated rows give
    repeated units. A column ``lang`` counts where a text in Latin script doesn't tell its language itself; it may be
    wrong, null or not there. Other columns are ignored.
    """
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in portions(texts):
                units = [sentence_units(t, n) for t, n in zip(texts[lo:hi], labels[lo:hi])]
                counts = np.fromiter(map(len, units), np.int64, len(units))
                flat = np.array([x for u in units for x in u], np.int32).reshape(-1, 2)
                row = np.repeat(np.arange(lo, hi), counts)
                columns = [b.column(0).take(pa.array(row)), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
                if with_text:
                    columns.append(pa.array([texts[r][x:y] for r, (x, y) in zip(row.tolist(), flat.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sent_start", "sent_end", "sentence"][: len(columns)])

    schema = "doc_id long, sent_start int, sent_end int" + (", sentence string" if with_text else "")
    return spread(documents.select("doc_id", "text", lang.cast("string").alias("lang"))).mapInArrow(run, schema)
