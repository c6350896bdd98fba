"""Vectorised pre-tokenisation for byte-level BPE, without a regular expression.

The split that is wanted is the one of ``public_tokenizers.PATTERN``: contractions, then runs of
letters, of numbers or of other characters, each with one leading space, then white space. Every
code point is first mapped to a symbol (an array look-up). Each symbol is a function from the state
before a character to the state after it; composing such functions is associative, so the states of
a whole batch come from a blocked prefix scan over arrays, with no loop over characters. Where a
token starts follows from the state before a character and its symbol.

A symbol that maps every state to the initial one stands between documents, so one scan serves many.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# symbols
S_T_M_D, R_V, E_, L_, LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE, BREAK = range(11)
# states: what the previous character was
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, AT_QUOTE, QUOTE_RV, QUOTE_L, DONE = range(10)
STATES = 10

# fixed values: code points with the Unicode property White_Space
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


@functools.cache
def symbols() -> np.ndarray:
    """Code point -> symbol."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for chars, symbol in (("stmd", S_T_M_D), ("rv", R_V), ("e", E_), ("l", L_)):
        out[[ord(c) for c in chars]] = symbol
    return out


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next[symbol, state], start[symbol, state], undo[symbol, state].

    ``start``: a token starts at this character. ``undo``: the character before, which had looked
    like the start of a run of letters, belongs to a contraction.
    """
    step = np.zeros((BREAK + 1, STATES), np.uint8)
    start = np.zeros((BREAK + 1, STATES), bool)
    undo = np.zeros((BREAK + 1, STATES), bool)
    for state in range(STATES):
        for symbol in (S_T_M_D, R_V, E_, L_, LETTER):
            step[symbol, state] = IN_LETTERS
            start[symbol, state] = state not in (IN_LETTERS, AFTER_SPACE, QUOTE_RV, QUOTE_L)
        for symbol, into in ((NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            step[symbol, state] = into
            start[symbol, state] = state not in (into, AFTER_SPACE)
        start[OTHER, AT_QUOTE] = False
        step[QUOTE, state] = IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, AT_QUOTE) else AT_QUOTE
        start[QUOTE, state] = step[QUOTE, state] == AT_QUOTE
        for symbol, into in ((SPACE, AFTER_SPACE), (WHITE, AFTER_WHITE)):
            step[symbol, state] = into
            start[symbol, state] = state not in (AFTER_SPACE, AFTER_WHITE)
        step[BREAK, state] = BEGIN
    step[S_T_M_D, AT_QUOTE], start[S_T_M_D, AT_QUOTE] = DONE, False
    step[R_V, AT_QUOTE], step[L_, AT_QUOTE] = QUOTE_RV, QUOTE_L
    for symbol, state in ((E_, QUOTE_RV), (L_, QUOTE_L)):
        step[symbol, state], undo[symbol, state] = DONE, True
    return step, start, undo


def scan(symbol: np.ndarray, width: int = 128) -> np.ndarray:
    """The state before each character, by composing transition functions in blocks of ``width``.

    A block's function is composed from its end backwards: once the composition is constant,
    what comes earlier in the block cannot matter. Few characters are enough, as a rule.
    """
    step = tables()[0].ravel().astype(np.intp)
    n = len(symbol)
    rows = -(-n // width)
    grid = np.full(rows * width, BREAK, np.intp)
    np.multiply(symbol, STATES, out=grid[:n], casting="unsafe")
    grid[n:] *= STATES
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    whole = np.tile(np.arange(STATES), (rows, 1))
    open_ = np.arange(rows)
    for column in grid[::-1]:
        before = step[column[open_, None] + np.arange(STATES)]
        whole[open_] = np.take_along_axis(whole[open_], before, axis=1)
        open_ = open_[(whole[open_] != whole[open_, :1]).any(axis=1)]
        if not len(open_):
            break
    # inclusive prefix composition over the blocks, by doubling
    far = 1
    while far < rows and (whole != whole[:, :1]).any():
        whole[far:] = np.take_along_axis(whole[far:], whole[:-far].copy(), axis=1)
        far *= 2
    now = np.zeros(rows, np.intp)
    now[1:] = whole[:-1, BEGIN]
    out = np.empty((width, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = now
        now = step[column + now]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where tokens start, as a mask over ``codes``; ``breaks`` are positions between documents,
    which are no token's start."""
    symbol = symbols()[codes]
    symbol[breaks] = BREAK
    state = scan(symbol)
    _, start, undo = tables()
    at = symbol.astype(np.intp) * STATES + state
    out = start.ravel()[at]
    back = np.flatnonzero(undo.ravel()[at])
    out[back - 1] = False
    # the last white space before something else stands alone or goes with it
    white = (symbol == SPACE) | (symbol == WHITE)
    last = white[:-1] & ~white[1:] & (symbol[1:] != BREAK)
    out[:-1][last] = True
    return out


def split(texts: list[str]) -> list[list[str]]:
    """The tokens of each text, in order; an empty text has none. Joined they give the text again."""
    if not texts:
        return []
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    mask = boundaries(codes, ends)
    # a token ends where the next one starts or, at a document's end, at the break
    mask[ends] = True
    edges = np.flatnonzero(mask)
    firsts = np.searchsorted(edges, ends)
    edges = edges.tolist()
    out, lo = [], 0
    for hi in firsts.tolist():
        own = edges[lo : hi + 1]
        out.append([joined[a:b] for a, b in zip(own, own[1:])])
        lo = hi + 1
    return out
