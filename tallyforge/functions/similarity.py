"""String similarity that Spark lacks, as Arrow-batched Pandas UDFs.

The ratios compare two short strings of one row; Spark decides which pairs
exist. ``indel`` is 2*LCS/(len a + len b), found with one big-integer step per
character.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


def _best_prefix(a: str, b: str) -> float:
    """Best ``indel`` of ``a`` against the beginnings of ``b`` no longer than ``a``; one pass."""
    n = len(a)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << n) - 1
    row, best = full, 0.0
    for i, ch in enumerate(b[:n], start=1):
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        score = 2.0 * (n - row.bit_count()) / (n + i)
        if score > best:
            best = score
    return best


def best_window(a: str, b: str, at_least: float = 0.0) -> float:
    """Best ``indel`` of the shorter text against the windows of the longer one.

    Windows are the full-width ones and the shorter ones cut off at either end.
    Full-width windows are skipped when the texts share too little to beat the
    best value so far (or ``at_least``).
    """
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long_ else at_least
    if short in long_:
        return 1.0
    n, m = len(short), len(long_)
    back, back_long = short[::-1], long_[::-1]
    best = max(at_least, _best_prefix(short, long_), _best_prefix(back, back_long))
    if n == m:
        return max(best, _best_prefix(long_, short), _best_prefix(back_long, back))
    if m > n + 1 and min(n, lcs_length(a, b)) / n > best:
        for i in range(1, m - n):
            best = max(best, indel(short, long_[i : i + n]))
    return best


def reference_similarity(a: str, b: str) -> float:
    """the best of F1, F2 and F3."""
    best = indel(a, b)
    best = best_window(a, b, best)
    da, db = digits_of(a), digits_of(b)
    return max(best, indel(da, db)) if da and db and best < 1.0 else best


def digits_of(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9").lstrip("0")


#: Longest text whose places fit into one machine word.
WORD = 62


class Alphabet:
    """The characters of some texts by number."""

    def __init__(self, texts: list[str]):
        letters = sorted(set("".join(texts)))
        self.code = {ch: i for i, ch in enumerate(letters)}
        self.points = np.array([ord(ch) for ch in letters], np.uint32)

    def lines(self, texts: list[str], m: int) -> np.ndarray:
        """Texts of ``m`` characters as columns."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), m)
        return np.searchsorted(self.points, raw).T.copy()

    def masks(self, a: str) -> np.ndarray:
        """For every character the places at which ``a`` has it."""
        out = np.zeros(len(self.code) + 1, np.uint64)
        for i, ch in enumerate(a):
            if ch in self.code:
                out[self.code[ch]] |= np.uint64(1 << i)
        return out


def _beginnings(codes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For columns in order: up to every place the distinct beginnings, as (the beginning one shorter, its last character);
    and the beginning that each whole column is."""
    fresh, number, out = np.zeros(codes.shape[1], bool), np.zeros(codes.shape[1], np.int64), []
    fresh[:1] = True
    for line in codes:
        fresh[1:] |= line[1:] != line[:-1]
        first = np.flatnonzero(fresh)
        out.append((number[first], line[first]))
        number = np.cumsum(fresh) - 1
    return out, number


class Texts(Alphabet):
    """Many texts, laid out so that one text is compared with all of them at once, a character of each at a time."""

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        self.texts, self.n = texts, len(texts)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        self.groups = []
        for m, at in sorted(by_length.items()):
            at, codes = np.array(at), self.lines([texts[i] for i in at], m)
            if m:
                order = np.lexsort(codes[::-1])
                at, codes = at[order], codes[:, order]
            self.groups.append((m, at, codes, _beginnings(codes)))


def _forward(masks: np.ndarray, n: int, beginnings: list[tuple[np.ndarray, np.ndarray]]):
    """The bit rows of the LCS of one text of ``n`` characters with distinct beginnings; equal ones are looked at once."""
    full = np.uint64((1 << n) - 1)
    row = np.full(1, full, np.uint64)
    for parent, line in beginnings:
        row = row[parent]
        hit = row & masks[line]
        row = ((row + hit) | (row - hit)) & full
        yield parent, row


def _steps(masks: np.ndarray, which: np.ndarray | None, n: int, codes: np.ndarray):
    """The bit rows of the LCS of a text of ``n`` characters with every column, after each character.

    ``masks`` are those of one text for all columns, or one line of masks for each text, and ``which`` says whose a column is.
    """
    full = np.uint64((1 << n) - 1)
    row = np.full(codes.shape[1], full, np.uint64)
    for line in codes:
        hit = row & (masks[line] if which is None else masks[which, line])
        row = ((row + hit) | (row - hit)) & full
        yield row


def _last(rows) -> np.ndarray:
    row = None
    for row in rows:
        pass
    return row


def _common(row: np.ndarray, n: int) -> np.ndarray:
    return n - np.bitwise_count(row).astype(np.int64)


def indel_to_all(a: str, others: Texts) -> np.ndarray:
    """``indel`` of ``a`` and every text."""
    out = np.empty(others.n)
    masks = others.masks(a) if len(a) <= WORD else None
    for m, at, _, (beginnings, number) in others.groups:
        if masks is None:
            out[at] = [indel(a, others.texts[i]) for i in at]
        elif not a or not m:
            out[at] = 0.0 if a or m else 1.0
        else:
            row = _last(row for _, row in _forward(masks, len(a), beginnings))
            out[at] = (2.0 * _common(row, len(a)) / (len(a) + m))[number]
    return out


def _own_beginnings(best: np.ndarray, row: np.ndarray, m: int, first: int) -> None:
    """Raises ``best`` to the ratios of the beginnings of a text with others of ``m``: the low places of their last rows."""
    for i in range(first, m + 1):
        low = np.bitwise_count(row & np.uint64((1 << i) - 1)).astype(np.int64)
        np.maximum(best, 2.0 * (i - low) / (m + i), out=best)


def _from_one_end(masks: np.ndarray, which: np.ndarray | None, n: int, codes: np.ndarray, best: np.ndarray, first: int = 1) -> np.ndarray:
    """Raises ``best`` to the ratios of windows that begin where the texts begin; gives what the whole texts have in common."""
    m = len(codes)
    for i, row in enumerate(_steps(masks, which, n, codes), start=1):
        if first <= i <= n <= m:  # beginnings of the longer text against all of the other
            np.maximum(best, 2.0 * _common(row, n) / (n + i), out=best)
    if n >= m:
        _own_beginnings(best, row, m, first)
    return _common(row, n)


def _inside(masks: np.ndarray, which: np.ndarray | None, n: int, codes: np.ndarray, whole: np.ndarray, best: np.ndarray, floor: float = 0.0) -> None:
    """Raises ``best`` to the ratios of full windows that touch neither end."""
    m = len(codes)
    most = np.minimum(whole, min(n, m)) / min(n, m)
    some = np.flatnonzero((most > best) & (most >= floor))
    if not len(some):
        return
    mine = None if which is None else which[some]
    for i in range(1, abs(m - n)):
        if n < m:
            inside = 2.0 * _common(_last(_steps(masks, mine, n, codes[i:i + n, some])), n) / (2 * n)
        else:
            part = (masks >> np.uint64(i)) & np.uint64((1 << m) - 1)
            inside = 2.0 * _common(_last(_steps(part, mine, m, codes[:, some])), m) / (2 * m)
        best[some] = np.maximum(best[some], inside)


def _window_to_all(a: str, others: Texts, floor: float = 0.0) -> np.ndarray:
    """The better of ``indel`` and ``best_window`` of ``a`` and every text; what is below ``floor`` may come out lower."""
    n, out = len(a), np.empty(others.n)
    masks, back = (others.masks(a), others.masks(a[::-1])) if n <= WORD else (None, None)
    for m, at, codes, (beginnings, number) in others.groups:
        if masks is None or not n or not m:
            out[at] = [best_window(a, others.texts[i], indel(a, others.texts[i])) for i in at]
            continue
        short = min(n, m)
        # A window of i characters has at most i in common, so shorter ones than this stay below the floor.
        first = max(1, math.ceil(floor * short / (2 - floor) - 1e-9))
        best = np.zeros(1)
        for i, (parent, row) in enumerate(_forward(masks, n, beginnings), start=1):
            best = best[parent]
            if first <= i <= n <= m:
                np.maximum(best, 2.0 * _common(row, n) / (n + i), out=best)
        whole = _common(row, n)
        np.maximum(best, 2.0 * whole / (n + m), out=best)
        if n >= m:
            _own_beginnings(best, row, m, first)
        best, whole = best[number], whole[number]
        near = np.flatnonzero(whole >= floor * (short + first) / 2 - 1e-9)
        if len(near):
            mine, lines, common = best[near], codes[:, near], whole[near]
            _from_one_end(back, None, n, lines[::-1], mine, first)
            _inside(masks, None, n, lines, common, mine, floor)
            best[near] = mine
        out[at] = best
    return out


class References:
    """Texts with their digits, to compare references with."""

    def __init__(self, texts: list[str]):
        self.whole, digits = Texts(texts), [digits_of(t) for t in texts]
        self.some = np.array([i for i, d in enumerate(digits) if d], np.int64)
        self.digits = Texts([digits[i] for i in self.some])

    def scores(self, a: str, floor: float = 0.0) -> np.ndarray:
        """``reference_similarity`` of ``a`` and every text; what is below ``floor`` may come out lower."""
        out, digits = _window_to_all(a, self.whole, floor), digits_of(a)
        if digits and len(self.some):
            out[self.some] = np.maximum(out[self.some], indel_to_all(digits, self.digits))
        return out


#: Pairs of a text and a beginning that are looked at together.
FRONT = 1_000_000


class Tree:
    """Texts of one length (columns of character numbers, with their owners) by their beginnings, to find those that have much in
    common with a text without looking at the others."""

    def __init__(self, codes: np.ndarray, owners: np.ndarray):
        order = np.lexsort(codes[::-1])
        beginnings, number = _beginnings(codes[:, order])
        self.owners, self.levels, n = owners[order], [], 1
        for parent, line in beginnings:
            self.levels.append((np.searchsorted(parent, np.arange(n + 1)), line))
            n = len(line)
        self.first = np.searchsorted(number, np.arange(n + 1))

    def search(self, masks: np.ndarray, size: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of asking text and owner whose LCS has ``need`` characters; ``masks``: a line for each asking text, of ``size``."""
        deep, full = len(self.levels), (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        some = np.flatnonzero((need <= size) & (need <= deep))
        todo, asked, found = [(0, some, np.zeros(len(some), np.int64), full[some])], [], []
        while todo:
            at, q, node, row = todo.pop()
            if at == deep:
                n = self.first[node + 1] - self.first[node]
                asked.append(np.repeat(q, n))
                found.append(self.owners[_runs(self.first[node], n)])
                continue
            begin, line = self.levels[at]
            n = begin[node + 1] - begin[node]
            if n.sum() > FRONT and len(q) > 1:
                half = len(q) // 2
                todo += [(at, q[half:], node[half:], row[half:]), (at, q[:half], node[:half], row[:half])]
                continue
            q, row, node = np.repeat(q, n), np.repeat(row, n), _runs(begin[node], n)
            hit = row & masks[q, line[node]]
            row = ((row + hit) | (row - hit)) & full[q]
            # What is still to come adds one character each at most.
            kept = np.flatnonzero(size[q] - np.bitwise_count(row) >= need[q] - (deep - at - 1))
            if len(kept):
                todo.append((at + 1, q[kept], node[kept], row[kept]))
        return (np.concatenate(asked), np.concatenate(found)) if asked else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of runs of ``n``, one after another."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


class Near:
    """Texts among which those are found whose F4 with a text reaches a floor, by what they must have in common with it.

    F4 is a ratio of two texts, of the shorter and a window of the longer, or of the digits. 2*LCS/(a + b) >= floor says how long
    the LCS must be for each two lengths, so every kind and length of window is a tree of its own.
    """

    def __init__(self, texts: list[str]):
        self.texts, self.letters, self.trees = texts, Alphabet(texts), {}
        self.by_length = self._lengths(texts)
        digits = [digits_of(t) for t in texts]
        self.digits = {m: x for m, x in self._lengths(digits).items() if m}

    def _lengths(self, texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        return {m: (self.letters.lines([texts[i] for i in at], m) if m else np.empty((0, len(at)), np.int64), np.array(at))
                for m, at in sorted(by_length.items())}

    def _tree(self, kind: str, n: int) -> Tree:
        """Of whole texts, their digits, beginnings, ends or windows of ``n`` characters."""
        if (kind, n) not in self.trees:
            if kind in ("whole", "digits"):
                parts = [(self.by_length if kind == "whole" else self.digits)[n]]
            else:
                places = {"begin": lambda m: [0], "end": lambda m: [m - n], "inside": lambda m: range(m - n + 1)}[kind]
                parts = [(codes[i:i + n], at) for m, (codes, at) in self.by_length.items() if m > n for i in places(m)]
            self.trees[kind, n] = Tree(np.concatenate([x[0] for x in parts], 1), np.concatenate([x[1] for x in parts])) if parts else None
        return self.trees[kind, n]

    def _questions(self, a: str, floor: float):
        """(kind, length, text, what they must have in common): a text of the floor answers one at least."""
        n, most = len(a), max(self.by_length)
        least = lambda x, y: max(1, math.ceil(floor * (x + y) / 2 - 1e-9))
        for m in self.by_length:
            yield "whole", m, a, least(n, m)
            if m <= n:
                for i in range(1, m):
                    yield "whole", m, a[:i], least(m, i)
                    yield "whole", m, a[n - i:], least(m, i)
                for i in range(n - m + 1 if m < n else 0):
                    yield "whole", m, a[i:i + m], least(m, m)
        for i in range(1, n if most >= n else 1):
            yield "begin", i, a, least(n, i)
            yield "end", i, a, least(n, i)
        if most > n:
            yield "inside", n, a, least(n, n)
        digits = digits_of(a)
        for m in self.digits if digits else ():
            yield "digits", m, digits, least(len(digits), m)

    def pairs(self, asking: list[str], floors: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``asking``, text, F4) of all pairs that reach the floor of the asking text."""
        questions: dict[tuple[str, int], list[tuple[int, str, int]]] = {}
        long_, out = [], []
        for i, (a, floor) in enumerate(zip(asking, floors)):
            if len(a) > WORD:
                long_.append(i)
                continue
            for kind, n, part, need in self._questions(a, floor):
                if need <= min(len(part), n):
                    questions.setdefault((kind, n), []).append((i, part, need))
        for key, mine in questions.items():
            tree = self._tree(*key)
            if tree is not None:
                number: dict[str, int] = {}
                which = np.array([number.setdefault(part, len(number)) for _, part, _ in mine])
                masks = np.stack([self.letters.masks(part) for part in number])[which]
                q, found = tree.search(masks, np.array([len(part) for _, part, _ in mine]), np.array([need for *_, need in mine]))
                out.append(_distinct(np.array([i for i, *_ in mine])[q] * len(self.texts) + found))
        both = _distinct(np.concatenate(out)) if out else np.empty(0, np.int64)
        who, text = both // len(self.texts), both % len(self.texts)
        score = self._scores(asking, who, text)
        if long_:
            every = References(self.texts)
            for i in long_:
                one = every.scores(asking[i], floors[i])
                who, text, score = np.append(who, np.full(len(one), i)), np.append(text, np.arange(len(one))), np.append(score, one)
        kept = np.flatnonzero(score >= np.asarray(floors, float)[who]) if len(who) else np.empty(0, np.int64)
        return who[kept], text[kept], score[kept]

    def _scores(self, asking: list[str], who: np.ndarray, text: np.ndarray) -> np.ndarray:
        """F4 of each pair of an asking text and one of the texts."""
        out = np.zeros(len(who))
        if not len(who):
            return out
        digits, short = [digits_of(a) for a in asking], [a if len(a) <= WORD else "" for a in asking]
        masks, back, of_digits = (np.stack([self.letters.masks(a) for a in x]) for x in (short, [a[::-1] for a in short], [
            d if a else "" for a, d in zip(short, digits)]))
        for (n, m), some in _by_lengths(short, who, self.by_length, text):
            codes, at = self.by_length[m]
            mine, lines, best = who[some], codes[:, np.searchsorted(at, text[some])], np.zeros(len(some))
            whole = _from_one_end(masks, mine, n, lines, best)
            np.maximum(best, 2.0 * whole / (n + m), out=best)
            _from_one_end(back, mine, n, lines[::-1], best)
            _inside(masks, mine, n, lines, whole, best)
            out[some] = best
        for (n, m), some in _by_lengths(digits, who, self.digits, text):
            codes, at = self.digits[m]
            common = _common(_last(_steps(of_digits, who[some], n, codes[:, np.searchsorted(at, text[some])])), n)
            out[some] = np.maximum(out[some], 2.0 * common / (n + m))
        return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """The numbers in order, each once; sorting is faster here than ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _by_lengths(asking: list[str], who: np.ndarray, texts: dict[int, tuple[np.ndarray, np.ndarray]], text: np.ndarray):
    """The pairs by the lengths of both texts, a part that fits the cache at a time; without those of an empty text."""
    sizes, of_text = np.array([len(a) for a in asking], np.int64)[who], np.zeros(int(text.max(initial=-1)) + 1, np.int64)
    for m, (_, at) in texts.items():
        of_text[at[at < len(of_text)]] = m
    both = sizes * (1 << 32) + of_text[text]
    for x in np.unique(both).tolist():
        n, m = x >> 32, x & 0xFFFFFFFF
        some = np.flatnonzero(both == x) if n and m else ()
        for first in range(0, len(some), 1 << 14):
            yield (n, m), some[first:first + (1 << 14)]


def _pair_ratios(a: list[str], b: list[str], windows: bool) -> np.ndarray:
    """``indel`` of each pair, or the better of it and ``best_window``; pairs of the same lengths at once."""
    out, alphabet = np.empty(len(a)), Alphabet(b)
    by_lengths: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        by_lengths.setdefault((len(x), len(y)), []).append(i)
    for (n, m), at in by_lengths.items():
        if not n or not m or n > WORD:
            out[at] = [best_window(a[i], b[i], indel(a[i], b[i])) if windows else indel(a[i], b[i]) for i in at]
            continue
        numbers: dict[str, int] = {}
        which = np.array([numbers.setdefault(a[i], len(numbers)) for i in at])
        masks, codes = np.stack([alphabet.masks(x) for x in numbers]), alphabet.lines([b[i] for i in at], m)
        if not windows:
            out[at] = 2.0 * _common(_last(_steps(masks, which, n, codes)), n) / (n + m)
            continue
        best = np.zeros(len(at))
        whole = _from_one_end(masks, which, n, codes, best)
        np.maximum(best, 2.0 * whole / (n + m), out=best)
        _from_one_end(np.stack([alphabet.masks(x[::-1]) for x in numbers]), which, n, codes[::-1], best)
        _inside(masks, which, n, codes, whole, best)
        out[at] = best
    return out


def reference_scores(a: list[str], b: list[str]) -> np.ndarray:
    """F4 of each pair."""
    out, x, y = _pair_ratios(a, b, True), [digits_of(t) for t in a], [digits_of(t) for t in b]
    some = [i for i in range(len(a)) if x[i] and y[i]]
    if some:
        out[some] = np.maximum(out[some], _pair_ratios([x[i] for i in some], [y[i] for i in some], False))
    return out


def _pairwise(fn):
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64"
        )

    return udf


# Deferred so that importing this module needs no running session.
def indel_ratio(a, b):
    """F1, and F5 on sorted tokens."""
    return _pairwise(indel)(a, b)


def partial_ratio(a, b):
    """F2."""
    return _pairwise(best_window)(a, b)


def reference_ratio(a, b):
    """F4 in one pass over the pairs."""

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(a), np.nan))
        there = np.flatnonzero(a.notna() & b.notna())
        out[there] = reference_scores(a.iloc[there].tolist(), b.iloc[there].tolist())
        return out.astype("Float64") if len(there) < len(a) else out

    return udf(a, b)


def sequence_ratio(a, b):
    """F11. difflib's ratio of the matching blocks."""
    return _pairwise(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())(a, b)
