"""Problem 9: sentence boundaries across languages and scripts.

A text falls into blocks: paragraphs, headings, list items; fenced code is left out. Within
a block every mark that may end a sentence is a candidate, and semi-Markov dynamic programming
chooses the spans between candidates with the best total score. A span's score adds up how its
last word closes (marks, abbreviations, initials, ellipses), how its first word opens (words
that open sentences, small letters, what goes on), whether it begins or ends inside a quotation
or bracket, whether it holds a word at all, and its length. The programme is exact for blocks of
any length: a span's score depends on its length only up to MIDDLE characters, so near
predecessors are tried one by one and of all farther ones the running best is kept. In Thai
blanks and line breaks separate sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import spread

# Abbreviations by what follows them, in lower case, without the last full stop.
# They end no sentence, whatever follows.
NEVER = frozenset("e.g i.e cf incl viz resp z.b d.h u.u bzw vgl sog inkl zzgl einschl p.ej p.ex par.ex ex c-à-d напр т.е см ср vs al".split())
# They stand before a name: no end before a capital letter.
TITLES = frozenset("dr mr mrs ms prof st sr sra dra jr hr fr herr frau dipl ing m mm mme mlle me d.ª dña г-н г-жа проф акад д-р डॉ श्री प्रो capt gen lt sgt rev hon don lic arq univ".split())
# They stand before a number or a label: no end before a digit or a small letter.
REFERENCES = frozenset("no nr nos nums fig figs sec sect ch chap vol p pp pág págs art eq ed abb abschn kap tab bd s z ca approx env aprox ок рис гл стр табл п разд ст núm cap tel ext ver rev u.a u".split())
# They may end a sentence: they do before an opening capital letter.
MAYBE = frozenset("etc usw usf u.s.w ff a.m p.m a.d b.c u.s u.k u.n e.u ee.uu d.c inc ltd co corp и.т.д т.д т.п др пр г гг в вв руб тыс млн a.c d.c Uhr ss".split())

#: Words that open sentences in Latin and Cyrillic script, in lower case.
OPENERS = frozenset(
    "the a an this that these those it he she we they you i one no each every most nobody when if then but and or so at in on for after before there here what why how who "
    "der die das ein eine kein keine jener jeder niemand wenn dann es wir sie er ich ab bei bitte das davor luego "
    "le la les un une ce cet cette aucun chaque quand si il elle on nous personne mais puis "
    "el los las una este esta ese nadie ningún cada cuando pero luego "
    "это если когда никто каждый сам самый стало по в на он она мы они но и".split()
)

#: Abbreviations of two parts, which may stand apart: 'z. B.'
_DOUBLE = frozenset(w for group in (NEVER, REFERENCES, MAYBE) for w in group if w.count(".") == 1)

_FENCE = regex.compile(r"^[>\s]*(`{3,}|~{3,})")
_HEADING = regex.compile(r"^[>\s]*#{1,6}(?:\s+|$)")
_ITEM = regex.compile(r"^[>\s]*(?:[-*+•‣·]|\(?\d{1,9}[.)]|\(?[A-Za-z][)])\s+")
_QUOTE = regex.compile(r"^(?:\s*>)+\s?")
_UNDERLINE = regex.compile(r"^\s*(?:={3,}|-{3,})\s*$")

_FACES = r"(?:[\p{Extended_Pictographic}\p{Emoji_Modifier}‍️]+|[:;=][-'^]?[)(DPpOo/\\|*\]]+(?!\w)|(?<!\w)[xX]D(?!\w)|(?<!\w)8-?\)|\^_?\^|<3(?!\w)|\(y\))"
_CLOSERS = r"[\"'”’»›“‘」』】》〉）)\]}*_~`]"
#: A run of marks, what closes after it, and faces.
_END = regex.compile(
    rf"(?P<mark>(?:[.!?…‥。！？｡．।॥؟۔‽⁇⁈⁉]|\s(?=[!?]))+)(?P<close>(?:{_CLOSERS}|\s(?=[»›]))*)(?P<face>(?:\s*{_FACES})*)"
)
_FACE_END = regex.compile(rf"(?<=[^\s.!?…。！？।؟])(?:\s+{_FACES})+(?=\s)")
_CLOSED_QUOTE = regex.compile(r"[。！？!?.…][」』”’\"]$")
_THAI = regex.compile(r"\p{Thai}")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
_LETTER = regex.compile(r"\p{L}")
_LAST = regex.compile(r"[\p{L}\p{M}\p{N}.$\-ª]+$")
_FIRST = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]")
_FULL = frozenset("。！？｡．।॥")
_OPEN_CLOSE = {"«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "{": "}"}
_CLOSE_OPEN = {v: k for k, v in _OPEN_CLOSE.items()}
_SPACE = regex.compile(r"[\s​‌‍⁠﻿]+")

#: What speaks against an end so strongly that nothing makes up for it.
NEVER_SCORE = -40.0
#: Length in characters up to which a span is as good as any; from there on each further one costs LONG.
SHORT, MIDDLE, LONG = 4, 400, 2e-5
#: A span that begins or ends inside a quotation or bracket, or holds no word.
UNBALANCED, WORDLESS, TINY = -8.0, -8.0, -0.3

def _rstrip(text: str, start: int, end: int) -> int:
    while end > start and (text[end - 1].isspace() or text[end - 1] in "​‌‍⁠﻿"):
        end -= 1
    return end


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of paragraphs, headings and list items, without their markers and without fenced code."""
    out: list[tuple[int, int]] = []
    start = None  # of the open block
    end = at = 0
    fence = None
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n\v\f\x1c\x1d\x1e\x85  ")
        a, b = at, at + len(body)
        at += len(line)
        mark = _FENCE.match(body)
        if fence:
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not body[mark.end() :].strip():
                fence = None
            continue
        head, item = _HEADING.match(body), _ITEM.match(body)
        bare = body[_QUOTE.match(body).end() :] if _QUOTE.match(body) else body
        if mark or not bare.strip() or head or item or _UNDERLINE.match(body):
            if start is not None:
                out.append((start, end))
                start = None
            if mark:
                fence = mark.group(1)
            elif head:
                out.append((a + head.end(), b))
            elif item:
                start, end = a + item.end(), b
            continue
        if start is None:
            start = a + (len(body) - len(bare))
        end = b
    if start is not None:
        out.append((start, end))
    return [(s, e) for s, e in out if text[s:e].strip()]


_PAIRS = regex.compile(r"[\"“”„‘’'«»‹›「」『』（）()\[\]【】《》{}]")


def _depths(t: str, places: list[int]) -> list[int]:
    """Open quotations and brackets before each of ``places`` (ascending); those never closed don't count."""
    change: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _PAIRS.finditer(t):
        ch, i = m.group(), m.start()
        want = None
        if ch == '"':
            want = '"'
        elif ch in _OPEN_CLOSE:
            stack.append((ch, i))
            continue
        elif ch in _CLOSE_OPEN:
            want = _CLOSE_OPEN[ch]
        elif ch == "„":
            stack.append(("„", i))
            continue
        elif ch == "“":
            if any(s[0] == "„" for s in stack):
                want = "„"
            else:
                stack.append(("“", i))
                continue
        elif ch == "”":
            want = "“" if any(s[0] == "“" for s in stack) else "„"
        elif ch in "'‘’":
            before, after = t[i - 1 : i], t[i + 1 : i + 2]
            if (not before or before.isspace() or before in "(\"“") and after.isalpha():
                stack.append(("'", i))
                continue
            if not before.isalnum() or not after.isalnum():
                want = "'"
            else:
                continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == want), None)
        if at is None:
            if ch == '"':
                stack.append(('"', i))
            continue
        change += [(stack[at][1] + 1, 1), (i + 1, -1)]
        del stack[at:]  # what was opened inside and not closed is dropped
    if not change:
        return [0] * len(places)
    change.sort()
    out, depth, k = [], 0, 0
    for p in places:
        while k < len(change) and change[k][0] <= p:
            depth += change[k][1]
            k += 1
        out.append(depth)
    return out


_HEAD = regex.compile(r"(\p{L}{1,3})\.\s?$")
_PART = regex.compile(r"(\p{L}{1,3})\.")
_LETTERS = regex.compile(r"(?:\p{L}\.)+\p{L}")
_REQUOTED = regex.compile(r"\s*\n(?:\s*>)+\s*")
_SOLID = regex.compile(r"[^\s​﻿]+")


def _closing_word(t: str, end: int) -> str:
    """The word before a full stop, in lower case, with its inner stops and the part before a blank of 'z. B'."""
    m = _LAST.search(t[max(0, end - 24) : end])
    word = m.group().lower().strip("-$") if m else ""
    if len(word) <= 2:
        head = _HEAD.search(t[max(0, end - 30) : end - len(word)])
        if head and (both := f"{head.group(1).lower()}.{word}") in _DOUBLE:
            word = both
    return word


def _border_score(t: str, m, nxt: int) -> float:
    """How well the match ``m`` closes a span, and what follows at ``nxt`` opens the next: abbreviations close by what opens behind them."""
    mark, close = m.group("mark"), m.group("close")
    opening = _FIRST.match(t, nxt)
    word = opening.group() if opening else ""
    ch = t[nxt]
    small = ch.islower()
    spaced = nxt > m.end()
    face = bool(m.group("face").strip())
    core = mark.strip()
    if ch in ",;:、，；：—–-)]}»”」』":
        return NEVER_SCORE
    score = 2.0
    if close.strip():
        if small:
            return NEVER_SCORE
        quote = any(c in "」』”’\"" for c in close)
        if not spaced and quote and _CJK.match(ch):
            return NEVER_SCORE  # the running sentence goes on behind the quotation
        score += 0.5
    if core and all(c in "….‥" for c in core) and not set(core) <= {"."}:
        return NEVER_SCORE if small or _CJK.match(ch) else 1.0 + face
    if core.startswith("..") or core.endswith(".."):
        return NEVER_SCORE if small and not face else 1.5
    if core[-1:] in _FULL or any(c in "!?！？؟‽⁇⁈⁉۔" for c in core):
        if small and not face:
            score -= 1.5
        return score + 1.0
    # full stops
    last = _closing_word(t, m.start("mark"))
    tail = last.rsplit(".", 1)[-1]
    part = _PART.match(t, nxt, min(len(t), nxt + 4))
    if part and f"{tail}.{part.group(1).lower()}" in _DOUBLE:
        return NEVER_SCORE
    for w in (last, tail):
        if w in NEVER:
            return NEVER_SCORE
    if last in MAYBE or (tail in MAYBE and last.count(".") == 1 and len(tail) > 2):
        return NEVER_SCORE if small or ch.isdigit() else 1.5 if word.lower() in OPENERS or not ch.isupper() else 0.7
    if last in TITLES and (ch.isupper() or ch.islower()):
        return NEVER_SCORE
    if last in REFERENCES and (ch.isdigit() or small or last in ("abb", "bd", "ca", "approx", "env")):
        return NEVER_SCORE
    if len(last) == 1 and last.isalpha():
        return NEVER_SCORE if t[m.start("mark") - 1].isupper() or small or ch.isdigit() else 0.5  # an initial
    if _LETTERS.fullmatch(last):
        return NEVER_SCORE if small or ch.isdigit() else 0.7
    if small and last.isdigit() and not face:
        return NEVER_SCORE  # an ordinal
    if small and not face:
        score -= 0.8
    elif word.lower() in OPENERS:
        score += 0.5
    return score


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``text``, in code points, ascending, without markers of headings and items. None and blank texts have none."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    for a, b in blocks(text):
        t = text[a:b]
        thai = _THAI.search(t) and len(_THAI.findall(t)) * 2 > len(_LETTER.findall(t))
        before = 0
        for e in _thai_ends(t) if thai else _block_ends(t):
            s = _LEADING.match(t, before).end()
            out.append((a + min(s, e), a + e))
            before = e
    return out


#: What may stand between two sentences of a block.
_LEADING = regex.compile(r"(?:[\s​‌‍⁠﻿]+|\n(?:[ \t]*>)+)*")


def sentence_ends(text: str | None) -> list[int]:
    """Ends of the sentences of ``text``, in code points, ascending."""
    return [e for _, e in sentence_spans(text)]


def _thai_ends(t: str) -> list[int]:
    out: list[int] = []
    for m in _SOLID.finditer(t):
        if out and not _LETTER.search(m.group()):
            out[-1] = m.end()  # faces, marks and numbers belong to what stands before them
        elif _WORDLIKE.search(m.group()):
            out.append(m.end())
    return out


def _block_ends(t: str) -> list[int]:
    last = _rstrip(t, 0, len(t))
    word = _WORDLIKE.search(t, 0, last)
    if not word:
        return []
    borders: dict[int, float] = {}
    for m in _END.finditer(t, 0, last):
        end = m.end()
        if end >= last:
            continue
        nxt = end
        s = _SPACE.match(t, nxt)
        if s:
            q = _REQUOTED.match(t, nxt, last)
            nxt = q.end() if q else s.end()
        if nxt >= last:
            continue
        core = m.group("mark").strip()
        if not core or word.start() >= m.start():
            continue
        # a mark between letters or digits ends nothing, save a full-width one
        if nxt == end and core[-1] not in _FULL and not (core[-1] in "…؟" or _CJK.match(t[nxt])):
            continue
        if nxt == end and core[-1] == "." and not m.group("face"):
            continue
        borders[end] = _border_score(t, m, nxt)
    for m in _FACE_END.finditer(t, 0, last):
        follow = _SPACE.match(t, m.end())
        if m.end() < last and not t[follow.end() if follow else m.end() :][:1].islower():
            borders.setdefault(m.end(), 0.5)
    if not borders:
        return [last]
    ends = sorted(borders)
    return best_spans(t, [0, *ends, last], [0.0, *(borders[e] for e in ends), 0.0])


def best_spans(t: str, places: list[int], border: list[float]) -> list[int]:
    """The ends of the spans of best total score that cover ``t`` from the first of ``places`` to the last.

    Exact: of predecessors farther away than MIDDLE only best + LONG * place matters, whose running
    maximum is kept; nearer ones are tried one by one, and there are no more of them than MIDDLE.
    """
    n = len(places)
    depth = _depths(t, places)
    inside = [UNBALANCED if d else 0.0 for d in depth]
    # where the first word behind each place begins
    first, at = [0] * n, len(t)
    for k in range(n - 1, -1, -1):
        m = _WORDLIKE.search(t, places[k], places[k + 1] if k + 1 < n else len(t))
        at = m.start() if m else at
        first[k] = at
    best, back = [0.0] * n, [0] * n
    far, far_at, k = float("-inf"), 0, 0  # best + LONG * place of the predecessors farther away than MIDDLE
    for j in range(1, n):
        end, top, own = places[j], float("-inf"), border[j] + inside[j]
        while places[k] < end - MIDDLE:
            value = best[k] + inside[k] + LONG * places[k]
            # a far predecessor has a word before this end unless all of its span is marks
            if value >= far and first[k] < end:
                far, far_at = value, k
            k += 1
        if far > float("-inf"):
            top, back[j] = far - LONG * (end - MIDDLE), far_at
        for i in range(k, j):
            score = best[i] + inside[i] + (TINY if end - places[i] < SHORT else 0.0) + (WORDLESS if first[i] >= end else 0.0)
            if score >= top:
                top, back[j] = score, i
        best[j] = top + own
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


_SCHEMA = "doc_id long, sentence_index int, start_char int, end_char int, sentence string"


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(doc, k, a, b, text[a:b]) for doc, text in zip(pdf["doc_id"], pdf["text"]) for k, (a, b) in enumerate(sentence_spans(text))]
        yield pd.DataFrame(rows, columns=["doc_id", "sentence_index", "start_char", "end_char", "sentence"])


def split_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence: doc_id, sentence_index, start_char, end_char, sentence.

    ``documents`` needs doc_id and text. Null and blank texts give no row. Each row is handled
    by itself: no shuffle, and a text of any length is one record of one task. Markers of headings
    and items, and fenced code, are in no sentence.
    """
    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(_sentences, _SCHEMA)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of all sentences of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return split_sentences(spread(documents, "doc_id")).select("doc_id", "end_char")


SQL: dict[str, str] = {}
