"""Splitting texts over a token limit at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle -
paragraph, line, sentence, clause, word - or, where an unbroken run fills the
middle, at the nearest boundary beside it; the halves are cut again while
they exceed the limit less the overlap.  Then each piece but the first is
prefixed with the last tokens of the piece before it, and its own token count is
taken from its text; should it pass the limit, its new part is cut once more.
Cuts never fall into a code point.  Runs without any boundary are cut between
tokens.  The new parts of all pieces, joined, give the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palaver.llm.tokens import VOCABULARY, Tokenizer, load, shared

LIMIT = 1200
OVERLAP = 80

# fixed values: what may stand before a cut, as code points; strength 1 is any white space
_SPACES = tuple(map(ord, " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"))
_CLAUSE = tuple(map(ord, ",;:)]}"))
_CLAUSE_WIDE = tuple(map(ord, "、，；："))
_SENTENCE = tuple(map(ord, ".!?…"))
_SENTENCE_WIDE = tuple(map(ord, "。！？"))
_CLOSING = tuple(map(ord, "'\")"))


def _fine(text: str, tok: Tokenizer, most: int) -> tuple[list[str], list[int], bool]:
    """Pre-tokens, their token counts, and whether any were divided: those over ``most`` tokens are, between tokens, at code points."""
    words = tok.words(text)
    counts = list(map(tok.count_of.__getitem__, words))
    if max(counts, default=0) <= most:
        return words, counts, False
    out, sizes = [], []
    for w, c in zip(words, counts):
        if c <= most:
            out.append(w)
            sizes.append(c)
            continue
        raw, held, n = tok.bytes_of(tok.encode(w)), b"", 0
        for i, b in enumerate(raw):
            held += b
            n += 1
            whole = i + 1 == len(raw) or raw[i + 1][0] & 0xC0 != 0x80
            if whole and (n >= most or i + 1 == len(raw)):
                out.append(held.decode())
                sizes.append(n)
                held, n = b"", 0
    return out, sizes, True


def _strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """Boundary strength at the start of each unit: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 white space, 0 none."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.isin(code, _SPACES)
    feed = code == 10
    feed[:-1] |= (code[:-1] == 13) & (code[1:] != 10)
    feed[-1] |= code[-1] == 13
    lines = np.r_[0, np.cumsum(feed)]
    ink = np.maximum.accumulate(np.where(space, -1, np.arange(len(code))))  # last visible character up to here
    last = np.r_[-1, ink][starts]
    breaks = lines[starts] - lines[last + 1]
    spaced = space[starts] | (last < starts - 1)
    end = code[np.maximum(last, 0)]
    mark = np.where(np.isin(end, _CLOSING) & (last > 0), code[np.maximum(last - 1, 0)], end)
    strength = spaced.astype(np.int8)
    strength[(spaced & np.isin(end, _CLAUSE)) | np.isin(end, _CLAUSE_WIDE)] = 2
    strength[(spaced & np.isin(mark, _SENTENCE)) | np.isin(end, _SENTENCE_WIDE)] = 3
    strength[breaks == 1] = 4
    strength[breaks > 1] = 5
    return strength


def _cut(a: int, b: int, cum: np.ndarray, strength: np.ndarray) -> int:
    """The strongest boundary in the middle half of units [a, b), the nearest to the midpoint on ties.

    Where the middle half has none at all, the boundary nearest to the midpoint anywhere;
    only a range without any is cut between tokens.
    """
    middle, reach = (cum[a] + cum[b]) / 2, (cum[b] - cum[a]) / 4
    lo = max(a + 1, int(np.searchsorted(cum, middle - reach, "left")))
    hi = min(b - 1, int(np.searchsorted(cum, middle + reach, "right")) - 1)
    if lo > hi:  # one unit fills the middle half
        lo = hi = min(max(a + 1, int(np.searchsorted(cum, middle))), b - 1)
    top = strength[lo : hi + 1].max()
    if not top and strength[a + 1 : b].any():
        best = np.flatnonzero(strength[a + 1 : b]) + a + 1
    else:
        best = np.flatnonzero(strength[lo : hi + 1] == top) + lo
    return int(best[np.argmin(np.abs(cum[best] - middle))])


def _tail(chars: np.ndarray, cum: np.ndarray, units: list[str], first: int, last: int, tokens: int, tok: Tokenizer) -> tuple[int, int, int]:
    """(char, unit, shared) where the last ``tokens`` tokens of units [first, last) begin; after a code point that a token would divide."""
    k = max(first, int(np.searchsorted(cum, cum[last] - tokens, "right")) - 1)
    over = int(cum[last] - cum[k]) - tokens
    if over <= 0:
        return int(chars[k]), k, tokens + over
    raw = units[k].encode()
    p = sum(map(len, tok.bytes_of(tok.ids_of[units[k]][:over])))
    while p < len(raw) and raw[p] & 0xC0 == 0x80:
        p += 1
    return int(chars[k + 1]) - len(raw[p:].decode()), k, tokens


def _count(text: str, start: int, at: int, last: int, chars: np.ndarray, cum: np.ndarray, units: list[str], tok: Tokenizer) -> int:
    """Tokens of text[start:chars[last]], which begins in unit ``at``.

    Pre-tokens are found left to right without looking back, so from the first
    pre-token that starts where a unit starts they are the units again - but for
    the white space at the end, where nothing follows any more.
    """
    tail = last
    while tail > at + 1 and units[tail - 1].isspace():
        tail -= 1
    head = 0
    if start != chars[at]:
        near = min(at + 12, tail)
        here, known = start, {int(c): i for i, c in enumerate(chars[at + 1 : near], at + 1)}
        for w in tok.words(text[start : chars[near]])[:-1]:
            head += tok.count_of[w]
            here += len(w)
            if here in known:
                at = known[here]
                break
        else:
            return tok.count(text[start : chars[last]])
    return head + int(cum[tail] - cum[at]) + (tok.count(text[chars[tail] : chars[last]]) if tail < last else 0)


def split_text(text: str, tok: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(start, new, end, tokens, shared) of each piece: it is text[start:end], its part before ``new`` repeats the piece before.

    ``shared`` is the number of the text's tokens repeated: ``overlap``, or
    fewer where the piece before is shorter or a token divides a code point.
    One piece for a text of at most ``limit`` tokens, the empty text included.
    """
    core = limit - overlap
    if overlap < 0 or core < 16:
        raise ValueError("the limit must exceed the overlap by 16 tokens at least")
    units, counts, divided = _fine(text, tok, max(4, core // 16))
    total = sum(counts)
    if divided:
        total = tok.count(text)
    if total <= limit:
        return [(0, 0, len(text), total, 0)]
    cum = np.r_[0, np.cumsum(np.asarray(counts, np.int64))]
    chars = np.r_[0, np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))]
    strength = _strengths(text, chars[:-1])
    done: list[tuple[int, int, int, int, int]] = []
    before, todo = None, [(0, len(units))]
    while todo:
        a, b = todo.pop()
        if (cum[b] - cum[a] <= core or b - a < 2) and (a, b) != (0, len(units)):
            new, end = int(chars[a]), int(chars[b])
            start, at, shared = (new, a, 0) if before is None else _tail(chars, cum, units, before, a, overlap, tok)
            n = tok.count(text[start:end]) if divided else _count(text, start, at, b, chars, cum, units, tok)
            if n <= limit or b - a < 2:
                done.append((start, new, end, n, shared))
                before = a
                continue
        k = _cut(a, b, cum, strength)
        todo += [(k, b), (a, k)]
    return done


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, path: str = VOCABULARY) -> DataFrame:
    """One row per piece: key, piece_no, n_pieces, char_start, char_new, char_end, n_tokens, overlap_tokens and piece.

    Every row of ``docs`` is split, repeated rows each.  A null text gives one
    piece that is null, an empty text one empty piece, both of 0 tokens.  A row
    stays in its task; ``with_text=False`` leaves ``piece`` out.
    """
    vocabulary = shared(docs, path)
    names = [key, "piece_no", "n_pieces", "char_start", "char_new", "char_end", "n_tokens", "overlap_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(vocabulary.value)
        for batch in batches:
            took, rows, pieces, size = [], [], [], 0

            def flush():
                cols = [batch.column(0).take(pa.array(took, pa.int64()))]
                cols += [pa.array(c, pa.int32() if i < 5 else pa.int64()) for i, c in enumerate(zip(*rows))]
                if with_text:
                    cols.append(pa.array(pieces, pa.string()))
                return pa.RecordBatch.from_arrays(cols, names=names + ["piece"] * with_text)

            for i, t in enumerate(batch.column(1).to_pylist()):
                cuts = split_text(t, tok, limit, overlap) if t else [(0, 0, 0, 0, 0)]
                for no, (start, new, end, n, common) in enumerate(cuts):
                    took.append(i)
                    rows.append((no, len(cuts), start, new, end, n, common))
                    if with_text:
                        pieces.append(None if t is None else t[start:end])
                        size += end - start
                if size > 16_000_000:
                    yield flush()
                    took, rows, pieces, size = [], [], [], 0
            if rows:
                yield flush()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, char_start int, char_new int, char_end int, n_tokens bigint, overlap_tokens bigint"
    return docs.select(key, text).mapInArrow(run, schema + (", piece string" if with_text else ""))
