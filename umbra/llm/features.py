"""Numbers of a text for the trained scorers: structure statistics and hashed distinct words, whole batches at once."""

from __future__ import annotations

import numpy as np

from umbra.llm.kernels import words

STATS = ("log_chars", "log_words", "log_lines", "upper", "digit", "punct", "space", "other", "pipe", "word_mean", "word_long", "word_short", "distinct", "top", "words_a_line", "lines_distinct", "capital_start", "odd_end")
_CLASS = np.full(256, 4, np.int64)  # 0 upper, 1 lower, 2 digit, 3 punctuation, 4 other, 5 space, 6 newline, 7 pipe, 8 continuation byte
_CLASS[0x21:0x7F] = 3
_CLASS[0x41:0x5B] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_CLASS[0x0A] = 6
_CLASS[0x7C] = 7
_CLASS[0x80:0xC0] = 8
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "!#$%&*@^~<>=|\\"]] = True


def _per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x STATS), bucket numbers of the distinct words of all texts, and the texts' offsets into them."""
    docs = len(offs) - 1
    size = np.diff(offs)
    kinds = np.zeros((docs, 9))
    at = 0
    while at < docs:  # some texts at a time, for bounded arrays
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1)
        b = _CLASS[data[offs[at] : offs[to]]]
        b += np.repeat(np.arange(to - at) * 9, size[at:to])
        kinds[at:to] = np.bincount(b, minlength=9 * (to - at)).reshape(-1, 9)
        at = to
    h, s, e, tok = words(data, offs)
    n = np.diff(tok).astype(np.float64)
    lines, _, _, line_at = words(data, offs, _LINE)
    n_lines = np.diff(line_at).astype(np.float64)
    doc = np.repeat(np.arange(docs), np.diff(tok))
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(hs)))
    word_at = np.searchsorted(ds[first], np.arange(docs + 1))
    top = np.zeros(docs)
    np.maximum.at(top, ds[first], runs)
    ldoc = np.repeat(np.arange(docs), np.diff(line_at))
    pairs = np.unique(np.stack([ldoc.astype(np.uint64), lines]), axis=1)[0].astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    distinct_lines = np.bincount(pairs, minlength=docs)
    length = (e - s).astype(np.float64)
    chars = np.maximum(kinds[:, :8].sum(1), 1)
    m, ml = np.maximum(n, 1), np.maximum(n_lines, 1)
    starts = (data[s] >= 0x41) & (data[s] < 0x5B) if len(s) else np.zeros(0, bool)
    ends = _ODD[data[e - 1]] if len(e) else np.zeros(0, bool)
    out = np.stack(
        [
            np.log1p(kinds[:, :8].sum(1)), np.log1p(n), np.log1p(n_lines), kinds[:, 0] / chars, kinds[:, 2] / chars, kinds[:, 3] / chars, (kinds[:, 5] + kinds[:, 6]) / chars, kinds[:, 4] / chars, kinds[:, 7] / m,
            _per_text(length, tok) / m, _per_text(length > 12, tok) / m, _per_text(length < 3, tok) / m, np.diff(word_at) / m, top / m, np.log1p(n / ml), distinct_lines / ml, _per_text(starts, tok) / m, _per_text(ends, tok) / m,
        ],
        axis=1,
    )
    return out, (hs[first] % np.uint64(buckets)).astype(np.int32), word_at
