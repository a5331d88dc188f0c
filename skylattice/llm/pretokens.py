"""Boundaries of pre-tokens without regular expressions.

The pattern of the byte-level vocabularies (contractions, runs of letters, digits or other signs with one leading
space, white space) is an automaton over classes of code points. Each position's class is looked up in an array; where
the pattern looks ahead (white space before a word, contractions) the class itself carries what follows, which is again
array arithmetic. A class is a function from state to state; functions compose associatively, so blocks of positions are
composed side by side, the blocks' functions scanned, and every position's state read off in a second sweep.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, DIGIT, SIGN, SHORT, LONG, SPACES, SPACE_END, OTHER_END, RESET = range(9)
_START, _LETTERS, _DIGITS, _SIGNS, _PREFIX, _BLANK, _ONE_MORE, _TWO_MORE = range(8)
#: The code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """LETTER, DIGIT, SIGN or SPACES for each code point, from the character database."""
    kind = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACES
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) for each (class, state)."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, run in ((LETTER, _LETTERS), (DIGIT, _DIGITS), (SIGN, _SIGNS)):
        step[kind] = run
        begins[kind, [run, _PREFIX]] = False
    step[LETTER, _ONE_MORE], step[LETTER, _TWO_MORE] = _START, _ONE_MORE
    begins[LETTER, [_ONE_MORE, _TWO_MORE]] = False
    for kind, rest in ((SHORT, _ONE_MORE), (LONG, _TWO_MORE)):  # an apostrophe that may open a contraction
        step[kind] = rest
        step[kind, [_SIGNS, _PREFIX]] = _SIGNS
        begins[kind, [_SIGNS, _PREFIX]] = False
    step[SPACES] = _BLANK
    begins[SPACES, _BLANK] = False
    step[SPACE_END], step[OTHER_END], step[RESET] = _PREFIX, _START, _START
    return step, begins


def classify(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes of the positions, with what the pattern sees ahead folded in; ``breaks`` are positions between texts."""
    kind = code_point_classes()[points]
    kind[breaks] = RESET
    follows = np.r_[kind[1:], np.uint8(RESET)]
    last = (kind == SPACES) & (follows != SPACES) & (follows != RESET)
    kind[last] = np.where(points[last] == 0x20, SPACE_END, OTHER_END)
    apostrophe = np.flatnonzero((points == 0x27) & (kind == SIGN))
    if apostrophe.size:
        padded = np.r_[points, np.zeros(2, points.dtype)]
        hidden = np.r_[kind == RESET, True, True]
        a = np.where(hidden[apostrophe + 1], 0, padded[apostrophe + 1])
        b = np.where(hidden[apostrophe + 1] | hidden[apostrophe + 2], 0, padded[apostrophe + 2])
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[apostrophe[short]], kind[apostrophe[long]] = SHORT, LONG
    return kind


def token_starts(kind: np.ndarray, block: int = 1024) -> np.ndarray:
    """Mask of the positions at which a token begins, by composing the classes' functions."""
    n = len(kind)
    if not n:
        return np.zeros(0, bool)
    step, begins = automaton()
    flat, first = step.ravel(), begins.ravel()
    block = max(16, min(block, int(n**0.5) + 1))
    rows = -(-n // block)
    sym = np.full(rows * block, RESET, np.uint8)
    sym[:n] = kind
    columns = np.ascontiguousarray(sym.reshape(rows, block).T) * np.uint8(8)
    composed = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in columns:
        composed = flat[c[:, None] + composed]
    # the scan over blocks: functions composed at distances 1, 2, 4 ...
    reach = 1
    while reach < rows:
        composed[reach:] = np.take_along_axis(composed[reach:], composed[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.r_[np.uint8(_START), composed[:-1, _START]]
    out = np.empty((block, rows), bool)
    for i, c in enumerate(columns):
        at = c + state
        out[i] = first[at]
        state = flat[at]
    out = out.T.ravel()[:n]
    return out & (kind != RESET)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of several texts.

    Returns (all bytes, byte position of each start, byte position of each end, code-point offset of each start in its
    text, number of pre-tokens of each text). Between texts lies one byte that belongs to none.
    """
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = classify(points, ends[:-1])
    starts = np.flatnonzero(token_starts(kind))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    text = np.searchsorted(ends, starts, side="left") if len(texts) else np.zeros(0, np.int64)
    stop = np.r_[starts[1:], 0]
    if len(starts):
        stop = np.minimum(np.r_[starts[1:], ends[-1]], ends[text])
    begin = ends - lengths
    return joined.encode("utf-8", "surrogatepass"), place[starts], place[stop[: len(starts)]], starts - begin[text] if len(starts) else starts, np.bincount(text, minlength=len(texts))
