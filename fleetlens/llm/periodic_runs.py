"""Runs of repeated words (maximal periodic stretches) found on a grammar of the word ids.

A run is a stretch with a smallest period q of at most half its length that no neighbour extends. The words
of a slice of whole texts are compressed by Re-Pair: the most frequent pair of neighbouring symbols of
a text becomes a nonterminal, again and again, until no pair of the text occurs twice; what is left is
paired up into a balanced tree. Words of different texts are different symbols, so texts never share a
rule, and rules of all texts in the slice are made side by side.

A run lies in some nonterminal and crosses the boundary between its two halves. There it is found
once, at the first place of the nonterminal, and carried over to all places the derivation puts it. What a
nonterminal shows is cut at its ends, so of the stretches with one period only those that no other holds
are runs.

Candidates for a period come from equal triples of words near a boundary: a run of ``least`` words or
more has, at its period's distance, at least three equal words on one side of it. How far they
agree is settled by binary search on hashes of prefixes, and each run is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are compressed side by side; a longer text is a slice of its own.
SLICE_WORDS = 250_000
#: Runs shorter than this are none, whatever their period.
LEAST = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Fixed value: the prime of the prefix hashes, below 2**31 so that products fit into 64 bits.
PRIME = 2_147_483_647


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: what ASCII white space leaves."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_ids(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): all words of the texts in a row; no id occurs in two texts."""
    ends = np.cumsum([len(words) for words in texts], dtype=np.int64)
    ids: list[int] = []
    for words in texts:
        # The id of a word is the place at which the text has it first.
        ids += map({}.setdefault, words, count(len(ids)))
    return np.array(ids, np.int64), ends


class Grammar:
    """The places of all nonterminals: ``rule``, and the first, middle and end word of each place.

    A place of a rule is recorded when its pair is replaced, also if a larger rule takes it in later.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.n = n
        self.text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        # One symbol behind the last word closes the row.
        self.symbol = np.append(ids, n)
        self.after = np.arange(1, n + 2)
        self.before = np.arange(-1, n)
        self.held = np.ones(n + 1, bool)
        self.held[n] = False
        self.rules = n + 1
        self.places: list[tuple[np.ndarray, ...]] = []
        self._repair()
        self._balance()
        parts = zip(*self.places) if self.places else [[np.empty(0, np.int64)]] * 4
        self.rule, self.first, self.middle, self.end = map(np.concatenate, parts)

    def _replace(self, heads: np.ndarray, rules: np.ndarray) -> None:
        """Put ``rules`` in place of the symbols at ``heads`` and behind them."""
        seconds = self.after[heads]
        behind = self.after[seconds]
        self.symbol[heads] = rules
        self.held[seconds] = False
        self.after[heads] = behind
        self.before[behind] = heads
        self.places.append((rules, heads, seconds, behind))

    def _repair(self) -> None:
        best = np.full(2 * self.n + 2, np.iinfo(np.int64).max)
        live = np.arange(self.n)
        while True:
            live = live[self.held[live]]
            live = live[self.held[self.after[live]]]
            left, right = self.symbol[live], self.symbol[self.after[live]]
            key = left << 32 | right
            order = np.argsort(key, kind="stable")
            live, key = live[order], key[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            group = np.cumsum(new) - 1
            # Of a symbol met several times in a row, every second pair counts.
            taken = np.ones(len(live), bool)
            twins = np.flatnonzero(left[order] == right[order])
            if len(twins):
                at = live[twins]
                chained = np.append(False, (self.after[at[:-1]] == at[1:]))
                start = np.flatnonzero(~chained)
                number = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                taken[twins] = number % 2 == 0
            times = np.bincount(group, taken, minlength=1).astype(np.int64)
            again = times >= 2
            if not again.any():
                return
            keep = again[group]
            live, key, taken, group = live[keep], key[keep], taken[keep], group[keep]
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            pair, times, text = key[heads], times[again], self.text[live[heads]]
            most = np.zeros(int(text.max()) + 1, np.int64)
            np.maximum.at(most, text, times)
            # Pairs with the most places of their text go at once, if they share no symbol: then
            # the order among them does not matter.
            able = np.flatnonzero(times == most[text])
            a, b = pair[able] >> 32, pair[able] & 0xFFFFFFFF
            rank = able * 0x9E3779B1 % (1 << 32)
            np.minimum.at(best, a, rank)
            np.minimum.at(best, b, rank)
            chosen = able[(best[a] == rank) & (best[b] == rank)]
            best[a] = best[b] = np.iinfo(np.int64).max
            number = np.full(len(heads), -1)
            number[chosen] = self.rules + np.arange(len(chosen))
            self.rules += len(chosen)
            if self.rules > len(best):
                best = np.full(2 * self.rules, np.iinfo(np.int64).max)
            rules = np.repeat(number, np.diff(np.append(heads, len(live))))
            at = np.flatnonzero(taken & (rules >= 0))
            self._replace(live[at], rules[at])
            near = self.before[live[at]]
            live = np.sort(np.concatenate([live, near[near >= 0]]))
            live = live[np.append(True, live[1:] != live[:-1])]

    def _balance(self) -> None:
        """Pair up neighbours of each text until one symbol is left of it."""
        while True:
            at = np.flatnonzero(self.held)
            if not len(at):
                return
            text = self.text[at]
            start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            sizes = np.diff(np.append(start, len(at)))
            number = np.arange(len(at)) - np.repeat(start, sizes)
            heads = at[(number % 2 == 0) & (number + 1 < np.repeat(sizes, sizes))]
            if not len(heads):
                return
            self._replace(heads, self.rules + np.arange(len(heads)))
            self.rules += len(heads)


class Prefixes:
    """Equality of stretches by hashes of all prefixes, with a random base."""

    def __init__(self, ids: np.ndarray, seed: int):
        n, base = len(ids), int(np.random.default_rng(seed).integers(1 << 20, 1 << 30))
        self.power, size = np.ones(n + 1, np.int64), 1
        while size <= n:
            more = min(size, n + 1 - size)
            self.power[size : size + more] = self.power[:more] * pow(base, size, PRIME) % PRIME
            size *= 2
        terms = (ids + 1) % PRIME * self.power[:n] % PRIME
        self.total = np.append(0, np.cumsum(terms)) % PRIME

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a and from b on have equal hashes; a lies before b."""
        left = (self.total[a + size] - self.total[a]) % PRIME * self.power[b - a]
        return (left - (self.total[b + size] - self.total[b])) % PRIME == 0

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a and b on (or before them, if ``back``) are equal, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            shift = middle if back else 0
            good = self.same(a[open_] - shift, b[open_] - shift, middle)
            low[open_[good]] = middle[good]
            high[open_[~good]] = middle[~good] - 1


def _meetings(
    ids: np.ndarray, first: np.ndarray, middle: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(place, signed distance): equal triples at a middle, or three words before it, and elsewhere in
    the place; the distance is that from the middle's triple to the other one."""
    n = len(ids)
    wide = ids.astype(np.uint64)
    mixed = wide[: n - 2] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= wide[1 : n - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + (mixed >> np.uint64(31))
    mixed ^= wide[2:] * np.uint64(0x165667B19E3779F9) + (mixed << np.uint64(17))
    order = np.argsort(mixed, kind="stable")
    sorted_ = mixed[order]
    group = np.cumsum(np.append(True, sorted_[1:] != sorted_[:-1])) - 1
    sizes = np.bincount(group)
    of = np.empty(n - 2, np.int64)
    of[order] = group
    spot = group * n + order  # rises, as places rise within a group
    out = []
    for shift in (0, -3):
        at = middle + shift
        ok = np.flatnonzero((at >= first) & (at + 3 <= end))
        ok = ok[sizes[of[at[ok]]] > 1]
        base = of[at[ok]] * n
        low = np.searchsorted(spot, base + first[ok])
        high = np.searchsorted(spot, base + end[ok] - 3, "right")
        held = high - low
        place = np.repeat(ok, held)
        begin = np.repeat(low - (np.cumsum(held) - held), held)
        other = order[begin + np.arange(len(place))]
        out.append((place, other - at[place]))
    place, gap = map(np.concatenate, zip(*out))
    return place[gap != 0], gap[gap != 0]


def _crossing(
    ids: np.ndarray, rules: tuple[np.ndarray, ...], least: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, end, period) of the stretches at the boundary of each rule, cut at its ends."""
    first, middle, end = rules
    place, gap = _meetings(ids, first, middle, end)
    key = np.unique((place << 32) + gap + (1 << 31))
    place, gap = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
    period = np.abs(gap)
    # The words from ``a`` on are compared with those a period later.
    a = middle[place] - np.where(gap < 0, period, 0)
    b = a + period
    hashes = Prefixes(ids, seed)
    left = hashes.reach(a, b, a - first[place], True)
    right = hashes.reach(a, b, end[place] - b, False)
    good = left + right >= np.maximum(period, least - period)
    place, period = place[good], period[good]
    start, stop = (a - left)[good], (b + right)[good]
    # A stretch shows itself at multiples of its period too; the smallest one is listed first.
    order = np.lexsort((period, stop, start, place))
    place, start, stop, period = place[order], start[order], stop[order], period[order]
    same = (place[1:] == place[:-1]) & (start[1:] == start[:-1]) & (stop[1:] == stop[:-1])
    only = np.append(True, ~same)[: len(place)]
    return place[only], start[only], stop[only], period[only]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def runs_of(
    ids: np.ndarray, ends: np.ndarray, least: int = LEAST
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs, by text, start and period; starts count from the row's
    first word.

    ``least`` is nine or more: then five words or more agree around a boundary, three of them on one side.
    """
    if least < 9:
        raise ValueError("least must be 9 or more")
    none = np.empty(0, np.int64)
    if len(ids) < least:
        return none, none, none, none
    grammar = Grammar(ids, ends)
    long = np.flatnonzero(grammar.end - grammar.first >= least)
    rule = grammar.rule[long]
    order = np.lexsort((grammar.first[long], rule))
    long, rule = long[order], rule[order]
    if not len(long):
        return none, none, none, none
    head = np.flatnonzero(np.append(True, rule[1:] != rule[:-1]))
    sizes = np.diff(np.append(head, len(rule)))
    lead = long[head]
    for seed in count():
        number, start, stop, period = _crossing(
            ids, (grammar.first[lead], grammar.middle[lead], grammar.end[lead]), least, seed
        )
        # Hashes only propose: each stretch is compared word by word; if one is wrong, another base is taken.
        if _verified(ids, start, stop, period):
            break
    # To all places of the rule.
    at = _ranges(head[number], sizes[number])
    times = sizes[number]
    shift = grammar.first[long[at]] - np.repeat(grammar.first[lead[number]], times)
    start, stop, period = np.repeat(start, times) + shift, np.repeat(stop, times) + shift, np.repeat(period, times)
    # Of one period, those that no other holds; no two texts share a word.
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    text = grammar.text[start] if len(start) else none
    # The furthest end so far, within a period: ends of later periods are lifted above earlier ones.
    lift = (np.cumsum(np.append(False, period[1:] != period[:-1])) if len(period) else none) * (len(ids) + 1)
    far = np.maximum.accumulate(stop + lift) if len(stop) else none
    keep = np.append(True, (stop + lift)[1:] > far[:-1])[: len(stop)]
    text, start, stop, period = text[keep], start[keep], stop[keep], period[keep]
    order = np.lexsort((period, start))
    return text[order], start[order], stop[order], period[order]


def _verified(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> bool:
    return all(
        np.array_equal(ids[s : e - p], ids[s + p : e])
        for s, e, p in zip(start.tolist(), stop.tolist(), period.tolist())
    )


def _slices(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = words_of(text)
        if held and size + len(words) > SLICE_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _answers(texts: list[list[bytes]], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Per text: its words, its runs (start, length, period), and the words that stay."""
    ids, ends = word_ids(texts)
    text, start, stop, period = runs_of(ids, ends, least)
    # A word goes if a run holds it behind the run's first period.
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    goes = np.cumsum(change[:-1]) > 0
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    begin = 0
    for i, words in enumerate(texts):
        own = slice(bounds[i], bounds[i + 1])
        runs = np.stack([start[own] - begin, (stop - start)[own], period[own]], axis=1)
        if len(runs):
            kept = [w for w, out in zip(words, goes[begin : begin + len(words)].tolist()) if not out]
        else:
            kept = words
        yield len(words), runs, b" ".join(kept)
        begin += len(words)


def collapse_runs(
    rows: DataFrame,
    text: str = "text",
    runs: str = "runs",
    collapsed: str = "collapsed",
    words: str = "n_words",
    least: int = LEAST,
) -> DataFrame:
    """``rows`` with their runs of at least ``least`` words and the text without the repetitions.

    ``runs`` holds (start, length, period) in words by start and period; ``collapsed`` is the UTF-8 of the
    words, joined by one space, that no run holds behind its first period; ``words`` counts all words.
    Words are what ASCII white space leaves of the whole text. A null or empty text has no word, no
    run and an empty result. Each row is answered for itself, so repeated rows are answered
    each; other columns stay, columns with the output names are replaced, an empty table stays
    empty. Nothing is shuffled. A text must fit into a task, with some 200 bytes for each word.
    """

    @F.arrow_udf(f"struct<words: bigint, runs: {RUNS}, collapsed: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, found, lists, kept = [], [], [0], []
            for texts in _slices(t.as_py() for t in batch):
                for size, own, rest in _answers(texts, least):
                    sizes.append(size)
                    found.append(own)
                    lists.append(lists[-1] + len(own))
                    kept.append(rest)
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            structs = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)],
                names=["start", "length", "period"],
            )
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), structs),
                    pa.array(kept, pa.binary()),
                ],
                names=["words", "runs", "collapsed"],
            )

    found = rows.withColumn("_periodic", run(F.col(text).cast("string")))
    return found.withColumns(
        {name: F.col(f"_periodic.{key}") for name, key in
         ((words, "words"), (runs, "runs"), (collapsed, "collapsed"))}
    ).drop("_periodic")
