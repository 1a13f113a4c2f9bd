"""Problem 7: evaluation passages in the corpus.

Texts become sequences of normal words (characters for Chinese and Japanese). Each window of
a sequence is embedded by CGK random walks, which turn edit distance into Hamming distance:
at each step the current symbol is put out, and a random bit drawn for the step and the symbol
tells whether to move on, so that two windows fall back into step after an insertion, deletion
or change. Of each walk a few positions are sampled; equal samples make a candidate, and the
repetitions bring the recall up. Candidates are verified by exact alignment, each of them whose
document holds the equal runs that the verification asks for. A window is as long as the shortest
part of an item that counts as a leak.

The items are small and read by the driver in blocks of bounded size; the corpus is read once
for each block and never shuffled.
"""

from __future__ import annotations

import html
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import spread

#: Part of an item that has to be there.
PART = 0.4
#: Items handled in one pass over the corpus.
ITEM_BLOCK = 4000
#: Documents whose windows are walked together.
DOC_BLOCK = 512
#: Alignments made together, and cells of their tables.
ALIGN_BLOCK, ALIGN_CELLS = 128, 1 << 23
#: Alignment: a match counts 1.
MISMATCH, GAP = 1.0, 0.7
#: Scores are kept as whole numbers of this part.
TENTHS = 10
#: Of the covered part of an item so much has to be equal.
LEAST_EQUAL = 0.8


#: Share of the leaks at the limit of what counts that has to become a candidate.
RECALL = 0.985


@dataclass(frozen=True)
class Kind:
    """Parameters for one sort of symbol: symbols of a window, positions sampled of its walk, and the share of leaks at the limit that one repetition finds."""

    window: int
    samples: int
    hit: float
    recall: float = RECALL

    @property
    def repeats(self) -> int:
        """Repetitions that bring the recall up to what is asked."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.hit))


#: Words, and characters of scripts without spaces; what one repetition finds was measured on leaks of two fifths with every fifth symbol changed.
WORDS, CHARS = Kind(10, 6, 0.19), Kind(20, 9, 0.19)
_LONG = frozenset({"ja", "zh"})

# Cyrillic and Greek letters that look like Latin ones, after case folding.
_LOOKALIKE = str.maketrans(dict(zip("авеԁіјкмоԛрсѕтухһԝьпгαβεικνορτυχγω", "abeдijkmoqpcstyxhwьпгabeiкvoptuxyw")) | {"ԁ": "d", "к": "k", "κ": "k", "м": "m", "т": "t", "в": "b", "һ": "h", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ո": "n", "օ": "o", "ѵ": "v", "н": "h"})
_ESCAPE = regex.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_HIDDEN = regex.compile(r"[\p{Cf}᠎ᅟ️]")
_HYPHEN = regex.compile(r"(?<=\p{Ll})-[ \t]*\r?\n(?:[ \t]|//+|[#*>])*(?=\p{Ll})")
_MARKUP = regex.compile(r"(?<=\p{L})[*_`~]+(?=\p{L})")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def normal(text: str) -> str:
    """Without escapes, markup, hidden characters and differences of case, width and accents."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = text.replace("\\n", " ").replace("\\t", " ").replace('\\"', '"')
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = _HIDDEN.sub("", text)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        # accents of Latin, Greek and Cyrillic letters go; marks of other scripts are put together again
        text = unicodedata.normalize("NFC", regex.sub(r"(?<=[\p{Latin}\p{Greek}\p{Cyrillic}])\p{Mn}+", "", text))
        text = text.casefold().translate(_LOOKALIKE)
    else:
        text = text.lower()
    return _MARKUP.sub("", text)


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def chars(text: str) -> list[str]:
    return [c for w in _WORD.findall(text) for c in w]


def _numbers(symbols: list[str], cache: dict[str, int]) -> np.ndarray:
    """A number from 1 on for each symbol, the same in every process."""
    out = np.empty(len(symbols), np.int64)
    for i, s in enumerate(symbols):
        v = cache.get(s)
        if v is None:
            if len(cache) > 500_000:
                cache.clear()
            v = cache[s] = (xxhash.xxh32_intdigest(s) >> 1) + 1
        out[i] = v
    return out


class Walks:
    """The random walks and samples of one kind."""

    STEPS_PER_SYMBOL = 2
    BITS = 1024

    def __init__(self, kind: Kind, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.kind, self.steps = kind, kind.window * self.STEPS_PER_SYMBOL
        self.move = rng.integers(0, 2, (kind.repeats, self.steps, self.BITS), dtype=np.int8)
        self.sampled = [np.sort(rng.choice(self.steps * 3 // 4, kind.samples, replace=False)) for _ in range(kind.repeats)]
        self.salt = rng.integers(1, 2**62, (kind.repeats, self.steps), dtype=np.int64) | 1

    def keys(self, symbols: np.ndarray, repeat: int, at: np.ndarray | None = None) -> np.ndarray:
        """A key for the window that starts at each place of ``at``, by default at each symbol but the last ``window - 1``."""
        if at is None:
            at = np.arange(max(0, len(symbols) - self.kind.window + 1), dtype=np.int64)
        padded = np.append(symbols, 0)
        end = at + self.kind.window
        key = np.zeros(len(at), np.int64)
        sampled = set(self.sampled[repeat].tolist())
        for step in range(max(sampled) + 1):
            inside = at < end
            sym = np.where(inside, padded[np.minimum(at, len(symbols))], 0)
            if step in sampled:
                key = (key ^ sym) * self.salt[repeat, step]
                key ^= (key >> 29) & 0x7FFFFFFFF
            at = at + self.move[repeat, step][sym & (self.BITS - 1)]
        return key


@dataclass
class Items:
    """Items of one kind and their windows' keys for each repetition."""

    kind: Kind
    ids: list[int] = field(default_factory=list)
    symbols: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)
    runs: np.ndarray | None = None
    run_owners: np.ndarray | None = None
    run_places: np.ndarray | None = None
    run_filter: np.ndarray | None = None
    walks: Walks | None = None
    marks: dict[int, np.ndarray] = field(default_factory=dict)

    FILTER = 1 << 20

    def build(self) -> Items:
        self.walks = Walks(self.kind)
        for r in range(self.kind.repeats):
            k, o, s = [], [], []
            for i, sym in enumerate(self.symbols):
                # an item shorter than a window is one window
                sym = sym if len(sym) >= self.kind.window else np.concatenate([sym, np.zeros(self.kind.window - len(sym), np.int64)])
                keys = self.walks.keys(sym, r)
                k.append(keys)
                o.append(np.full(len(keys), i, np.int32))
                s.append(np.arange(len(keys), dtype=np.int32))
            k, o, s = np.concatenate(k), np.concatenate(o), np.concatenate(s)
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.owners.append(o[order])
            self.starts.append(s[order])
        runs = [_runs(x) for x in self.symbols]
        values, owners = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(x) for x in runs])
        order = np.argsort(values, kind="stable")
        places = np.concatenate([np.arange(len(x)) for x in runs])
        self.runs, self.run_owners, self.run_places = values[order], owners[order], places[order]
        return self

    def _filters(self) -> None:
        """Bit tables that say quickly what no item has; they are made where they are used rather than sent."""
        self.seen = [np.zeros(self.FILTER, bool) for _ in self.keys]
        for seen, keys in zip(self.seen, self.keys):
            seen[keys & (self.FILTER - 1)] = True
        self.run_filter = np.zeros(self.FILTER, bool)
        self.run_filter[self.runs & (self.FILTER - 1)] = True
        # the equal runs that a leak has at least: of three symbols, of items too short for that of two, or single ones
        self.marks = {}
        for x in self.symbols:
            length = 3 if least_runs(len(x)) >= 1 else 2 if len(x) >= 3 else 1
            seen = self.marks.setdefault(length, np.zeros(self.FILTER, bool))
            seen[_ngrams(x, length) & (self.FILTER - 1)] = True

    def worth(self, symbols: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an equal run, such as the verification asks for, of some item."""
        n, w = len(symbols) - self.kind.window + 1, self.kind.window
        if n <= 0:
            return np.zeros(0, np.int64)
        count = np.zeros(len(symbols) + 1, np.int64)
        for length, seen in self.marks.items():
            hit = np.flatnonzero(seen[_ngrams(symbols, length) & (self.FILTER - 1)])
            # a run that starts at h lies in the windows from h + length - w to h; at the end of the sequence they are fewer
            np.add.at(count, np.maximum(0, hit + length - w), 1)
            np.add.at(count, hit + 1, -1)
        return np.flatnonzero(np.cumsum(count[:n]) > 0)

    def candidates(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place of its first symbol and place of the window, for each window of the sequence that shares a key with one of the item."""
        if not self.seen:
            self._filters()
        items, places, hits = [], [], []
        worth = self.worth(symbols)
        for r in range(self.kind.repeats):
            keys = self.walks.keys(symbols, r, worth)
            found = np.flatnonzero(self.seen[r][keys & (self.FILTER - 1)])
            hit = worth[found]
            lo = np.searchsorted(self.keys[r], keys[found], "left")
            many = np.searchsorted(self.keys[r], keys[found], "right") - lo
            each = np.repeat(np.arange(len(hit)), many)
            j = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            items.append(self.owners[r][j])
            places.append(hit[each] - self.starts[r][j])
            hits.append(hit[each])
        return np.concatenate(items), np.concatenate(places), np.concatenate(hits)

    def runs_in_bands(self, symbols: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """For each row (sequence, item) the most equal runs in a stretch of the item and a band of distances, as ``runs_together`` asks for them.

        Bands of twice the width at every other width, for all pairs at once; a run that occurs twice counts
        twice, so nothing is counted too low.
        """
        runs = _runs(symbols)
        kept = np.flatnonzero(self.run_filter[runs & (self.FILTER - 1)])
        lo = np.searchsorted(self.runs, runs[kept], "left")
        many = np.searchsorted(self.runs, runs[kept], "right") - lo
        each = np.repeat(np.arange(len(kept)), many)
        if not len(each):
            return np.zeros(len(pairs), np.int64)
        j = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        item, place, at = self.run_owners[j], self.run_places[j], kept[each]
        own = np.searchsorted(starts, at, "right") - 1
        sizes = np.array([len(x) for x in self.symbols])
        band = (at - starts[own] - place + sizes[item]) // _band(sizes)[item]
        span = band.max() + 2
        found, inverse = np.unique((own * len(sizes) + item) * span + band, return_inverse=True)
        table = np.bincount(inverse * STEPS + place // _step(sizes)[item], minlength=len(found) * STEPS).reshape(-1, STEPS).cumsum(1)
        table[:, STRETCH:] -= table[:, :-STRETCH].copy()
        both, next_ = table.copy(), np.flatnonzero(np.diff(found) == 1)
        both[next_] += table[next_ + 1]
        pair = found // span
        first = np.flatnonzero(np.append(True, np.diff(pair) != 0))
        best, pair = np.maximum.reduceat(both.max(1), first), pair[first]
        asked = pairs[:, 0] * len(sizes) + pairs[:, 1]
        k = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
        return np.where(pair[k] == asked, best[k], 0)


def align_many(items: list[np.ndarray], regions: list[np.ndarray]) -> list[tuple[int, int]]:
    """(covered, equal) for each item and its region: of the best local alignment, the item's symbols from its first to its last match, and the matches.

    The tables are filled row by row for all pairs at once, in whole tenths, the shorter ones padded with what equals nothing.
    """
    n, m = max(map(len, items)), max(map(len, regions))
    gap, mismatch = round(TENTHS * GAP), round(TENTHS * MISMATCH)
    kind = np.int16 if TENTHS * n + gap * m < 2**15 else np.int32
    _, small = np.unique(np.concatenate([*items, *regions]), return_inverse=True)
    small, at = small.astype(np.int32), 0
    x, y = np.full((n, len(items)), -2, np.int32), np.full((m, len(items)), -3, np.int32)
    for k, item in enumerate(items):
        x[: len(item), k], at = small[at : at + len(item)], at + len(item)
    for k, region in enumerate(regions):
        y[: len(region), k], at = small[at : at + len(region)], at + len(region)
    h = np.zeros((n + 1, m + 1, len(items)), kind)
    tops = np.zeros((n + 1, len(items)), kind)
    for i in range(1, n + 1):
        row = h[i, 1:]
        np.add(h[i - 1, :-1], np.where(y == x[i - 1], kind(TENTHS), kind(-mismatch)), out=row)
        np.maximum(row, h[i - 1, 1:] - kind(gap), out=row)
        np.maximum(row, 0, out=row)
        # gaps along the row, by doubled steps as far as a score can reach
        step = 1
        while step < m and gap * step < TENTHS * i:
            np.maximum(row[step:], row[:-step] - kind(gap * step), out=row[step:])
            step *= 2
        tops[i] = row.max(axis=0)
    return [_trace(h[:, :, k], int(tops[:, k].argmax()), item, region) for k, (item, region) in enumerate(zip(items, regions))]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(covered, equal) of one item and region."""
    return align_many([item], [region])[0]


def _trace(h: np.ndarray, i: int, item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(covered, equal) read back from the table of an alignment and the row where it is best."""
    j = int(h[i].argmax())
    last, equal = i, 0
    first = i
    gap, mismatch = round(TENTHS * GAP), round(TENTHS * MISMATCH)
    while i > 0 and j > 0 and h[i, j] > 0:
        same = item[i - 1] == region[j - 1]
        here = int(h[i, j])
        if here - h[i - 1, j - 1] == (TENTHS if same else -mismatch):
            i, j = i - 1, j - 1
            if same:
                equal, first = equal + 1, i
        elif h[i, j - 1] - here == gap:
            j -= 1
        elif h[i - 1, j] - here == gap:
            i -= 1
        else:
            break
    return int(last - first), int(equal)


def _ngrams(x: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` symbols, its last bits well mixed."""
    out = x[: max(0, len(x) - length + 1)].astype(np.int64)
    for k in range(1, length):
        out = out * 1_000_003 + x[k : len(x) - length + 1 + k]
    return out ^ (out >> 23)


def _runs(x: np.ndarray) -> np.ndarray:
    """A number for each run of three symbols."""
    return _ngrams(x, 3)


#: Steps of an item in which equal runs are counted, and how many make up PART of it and one more.
STEPS = 20
STRETCH = math.ceil(PART * STEPS) + 1


def _step(size):
    """Symbols of a step of an item."""
    return np.maximum(1, -(-size // STEPS))


def _band(size):
    """How much the distances of runs that stand together may differ: a short insertion shifts what follows."""
    return 12 + size // 8


def runs_together(item: np.ndarray, region: np.ndarray, need: float) -> bool:
    """Whether about PART of an item and a region have ``need`` equal runs at distances that differ little: what is leaked in one place has them so."""
    a, b, n = _runs(item), _runs(region), len(item)
    order = np.argsort(b, kind="stable")
    b = b[order]
    lo = b.searchsorted(a, "left")
    many = b.searchsorted(a, "right") - lo
    total = int(many.sum())
    if total < need:
        return False
    at_item = np.arange(len(a)).repeat(many)
    at = order[lo[at_item] + np.arange(total) - (many.cumsum() - many).repeat(many)]
    # any two fifths of the item lie in one of the stretches of STRETCH steps, a step longer; an insertion shifts what follows
    step, width, span = int(_step(n)), _band(n), len(a) + len(b)
    rows = -(-len(a) // step)
    table = np.bincount((at_item // step) * span + at - at_item + len(a), minlength=rows * span).reshape(rows, span).cumsum(0)
    table[STRETCH:] -= table[:-STRETCH].copy() if rows > STRETCH else 0
    table = table.cumsum(1)
    table[:, width:] -= table[:, :-width].copy()
    return bool(table.max() >= need)


def least_runs(size):
    """Equal runs that a region needs, for one size of item or an array of them.

    Of the least part, PART of the item, a share of 1 - LEAST_EQUAL may have changed, and each change breaks three
    runs at most; two fewer for the ends, two for an insertion.
    """
    return np.maximum(0, PART * np.asarray(size) * (1 - 3 * (1 - LEAST_EQUAL)) - 4)


def are_leaks(items: list[np.ndarray], regions: list[np.ndarray]) -> list[bool]:
    """Whether each region holds PART of its item in order, with LEAST_EQUAL of it unchanged."""
    out = [False] * len(items)
    kept = [k for k, (x, y) in enumerate(zip(items, regions)) if len(y) and (least_runs(len(x)) <= 0 or runs_together(x, y, float(least_runs(len(x)))))]
    kept.sort(key=lambda k: len(items[k]))
    while kept:
        size, width = len(items[kept[-1]]), max(len(regions[k]) for k in kept[-ALIGN_BLOCK:])
        most = min(ALIGN_BLOCK, max(1, ALIGN_CELLS // (size * width)))
        part, kept = kept[-most:], kept[:-most]
        for k, (covered, equal) in zip(part, align_many([items[k] for k in part], [regions[k] for k in part])):
            need = PART * len(items[k])
            out[k] = covered >= need - 1e-9 and equal >= LEAST_EQUAL * covered and equal >= LEAST_EQUAL * need
    return out


def leaks(sequences: list[np.ndarray], items: Items) -> list[tuple[int, int]]:
    """(sequence, item) pairs of indexes: the items that each sequence leaks.

    The sequences are walked as one array with a window's length of nothing behind each, so that no
    window reaches into the next one and a sequence's candidates are the same whatever stands beside
    it. One shared key makes a candidate; what is verified lies inside one sequence.
    """
    if not sequences or not items.ids:
        return []
    gap = np.zeros(items.kind.window, np.int64)
    joined = np.concatenate([x for s in sequences for x in (s, gap)]).astype(np.int64)
    starts = np.cumsum([0] + [len(s) + len(gap) for s in sequences])
    item, place, hit = items.candidates(joined)
    sizes = np.array([len(x) for x in items.symbols])
    # the sequence that holds the window, though the item's first symbol may lie before it
    own = np.searchsorted(starts, hit, "right") - 1
    strides = np.maximum(8, sizes // 2)
    slot = (place - starts[own]) // strides[item]
    low = slot.min(initial=0)
    span = slot.max(initial=0) - low + 1
    code = np.unique((own * len(sizes) + item) * span + slot - low)
    where = np.stack([code // span // len(sizes), code // span % len(sizes), code % span + low], axis=1)
    need = least_runs(sizes[where[:, 1]])
    where = where[(need <= 0) | (items.runs_in_bands(joined, starts, where[:, :2]) >= need)]
    regions = []
    for o, i, slot in where.tolist():
        size, g = len(items.symbols[i]), max(8, len(items.symbols[i]) // 2)
        regions.append(sequences[o][max(0, slot * g - 16) : max(0, slot * g + size + size // 4 + 16 + g)])
    right = are_leaks([items.symbols[i] for i in where[:, 1]], regions)
    return sorted({(o, i) for (o, i, _), ok in zip(where.tolist(), right) if ok})


def make_items(rows: list) -> tuple[Items, Items]:
    """Items by words and by characters from rows (item_id, lang, passage); passages without symbols are left out."""
    by_word, by_char, cache = Items(WORDS), Items(CHARS), {}
    for item_id, lang, passage in rows:
        if item_id is None or not passage:
            continue
        text = normal(passage)
        wide = (lang or "").lower()[:2] in _LONG or len(_WIDE.findall(text)) * 2 > len(_WORD.sub("", text)) + sum(map(len, _WORD.findall(text)))
        to = by_char if wide else by_word
        sym = _numbers(chars(text) if wide else words(text), cache)
        if len(sym):
            to.ids.append(item_id)
            to.symbols.append(sym)
    return (by_word.build() if by_word.ids else by_word), (by_char.build() if by_char.ids else by_char)


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: the documents and the items they leak.

    ``documents`` needs doc_id and text, ``eval_items`` item_id, lang and passage. Null and
    blank texts leak nothing; items without a word can't leak. Items are read in blocks of
    ITEM_BLOCK, each of them against all of the corpus, so any number of items is whole.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    out, block = None, []

    def against(rows: list) -> DataFrame:
        by_word, by_char = make_items(rows)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache: dict[str, int] = {}
            for pdf in batches:
                found = []
                ids, normals = pdf["doc_id"].tolist(), [normal(t) for t in pdf["text"]]
                for s in range(0, len(ids), DOC_BLOCK):
                    part = normals[s : s + DOC_BLOCK]
                    found += [(ids[s + o], by_word.ids[i]) for o, i in leaks([_numbers(words(t), cache) for t in part], by_word)]
                    if by_char.ids:
                        wide = [k for k, t in enumerate(part) if _WIDE.search(t)]
                        found += [(ids[s + wide[o]], by_char.ids[i]) for o, i in leaks([_numbers(chars(part[k]), cache) for k in wide], by_char)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id"])

        return texts.mapInPandas(scan, "doc_id long, item_id long")

    for r in eval_items.select("item_id", "lang", "passage").toLocalIterator():
        block.append(tuple(r))
        if len(block) == ITEM_BLOCK:
            out, block = against(block) if out is None else out.unionByName(against(block)), []
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    return out.distinct() if out is not None else spark.createDataFrame([], "doc_id long, item_id long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all evaluation items."""
    return find_leaks(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


SQL: dict[str, str] = {}
