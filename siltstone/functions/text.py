"""Words, identifiers and queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.scalar import constant

SPECIAL, MAX_QUERY_TERMS = fixed.SPECIAL, fixed.MAX_QUERY_TERMS


def fts_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits longer than one, with repeats."""
    return F.filter(F.split(F.lower(text), r"[\s\W_]+"), lambda w: F.length(w) > 1)


def index_tokens(*texts: Column) -> Column:
    """Lower-case runs of letters and digits of any script: what the inverted index holds."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_camel(name: Column) -> Column:
    """Parts of a name in camel, snake or kebab case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[\s_-]+"), lambda p: p != "")


def extract_identifiers(code: Column) -> Column:
    """Distinct identifiers in lower case, keywords and single letters left out. Null gives null."""
    found = F.flatten(F.array(*(F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in fixed.IDENTIFIER_PATTERNS)))
    words = constant(fixed.KEYWORDS)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 1) & ~F.array_contains(words, w)))


def identifiers_of(code: str) -> list[str]:
    """``extract_identifiers`` of one text, outside of a plan."""
    found = [w.lower() for p in fixed.IDENTIFIER_PATTERNS for w in re.findall(p, code, re.A)]
    return list(dict.fromkeys(w for w in found if len(w) > 1 and w not in fixed.KEYWORDS))


def camel_parts(word: str) -> list[str]:
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", word))
    return [p for p in re.split(r"[\s_-]+", spaced) if p]


def identifier_variants(parts: list[str]) -> list[str]:
    """Ways to write a name of at least two parts, small words dropped if two others are left."""
    parts = [p.lower() for p in parts]
    if len(parts) < 2:
        return []
    kept = [p for p in parts if p not in fixed.VARIANT_STOPWORDS]
    parts = kept if len(kept) >= 2 else parts
    camel = lambda ps: ps[0] + "".join(p[:1].upper() + p[1:] for p in ps[1:])
    return list(dict.fromkeys([" ".join(parts), camel(parts), "_".join(parts), camel(parts[:2]), camel(parts[-2:])]))


def variant_columns(parts: Column) -> Column:
    """``identifier_variants`` of an array column of parts."""
    low = F.transform(parts, F.lower)
    stop = constant(fixed.VARIANT_STOPWORDS)
    kept = F.filter(low, lambda p: ~F.array_contains(stop, p))
    use = F.when(F.size(kept) >= 2, kept).otherwise(low)
    camel = lambda ps: F.concat(F.element_at(ps, 1), F.array_join(F.transform(F.slice(ps, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), ""))
    made = F.array(F.array_join(use, " "), camel(use), F.array_join(use, "_"), camel(F.slice(use, 1, 2)), camel(F.slice(use, -2, 2)))
    return F.when(F.size(low) >= 2, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def expand_query(query: str) -> list[str]:
    """Terms of a query, in order: of each word itself in lower case, its synonyms, its parts of more than two letters, its variants."""
    out: dict[str, None] = {}
    for w in query.split():
        parts = [p.lower() for p in camel_parts(w)]
        out.update(dict.fromkeys([w.lower(), *fixed.SYNONYMS.get(w.lower(), []), *(p for p in parts if len(p) > 2), *identifier_variants(parts)]))
    return list(out)


def expand_columns(word: Column) -> Column:
    """``expand_query`` of a column of single words, as a distinct array; the table of synonyms is a map in the expression."""
    synonyms = constant(fixed.SYNONYMS)
    low, none = F.lower(word), F.array().cast("array<string>")
    parts = split_camel(word)
    long = F.filter(F.transform(parts, F.lower), lambda p: F.length(p) > 2)
    return F.array_distinct(F.concat(F.array(low), F.coalesce(F.element_at(synonyms, low), none), long, variant_columns(parts)))


def code_terms(query: str) -> list[str]:
    """Words of a query that may be identifiers."""
    return list(dict.fromkeys(w for w in re.findall(r"\b[a-zA-Z_$][\w$]*\b", query) if len(w) > 2 and w.lower() not in fixed.KEYWORDS))


def query_phrases(query: str) -> list[str]:
    """At most twenty phrases that a keyword search looks for, any of which is a hit."""
    clean = re.sub(r"\s+", " ", re.sub(SPECIAL, " ", query)).strip()
    if not clean:
        return []
    return list(dict.fromkeys(expand_query(clean) + code_terms(clean)))[:MAX_QUERY_TERMS]


def phrase_words(phrase: str) -> list[str]:
    """Words of a phrase as the index holds them."""
    return [w for w in re.split(r"[\W_]+", phrase.lower()) if w]


def prefix_query(query: str) -> str:
    """One word: its prefix; two to six: all prefixes; more: any of them. Words of one letter are left out."""
    words = [w for w in re.split(r"\s+", re.sub(SPECIAL, " ", query)) if len(w) >= 2]
    return ("" if not words else (" AND " if len(words) <= 6 else " OR ").join(f"{w}*" for w in words))


def prefix_query_column(query: Column) -> Column:
    """``prefix_query`` of a column. Null gives null."""
    words = F.filter(F.split(F.regexp_replace(query, SPECIAL, " "), r"\s+"), lambda w: F.length(w) >= 2)
    stars = F.transform(words, lambda w: F.concat(w, F.lit("*")))
    return F.when(F.size(words) <= 6, F.array_join(stars, " AND ")).otherwise(F.array_join(stars, " OR "))


def shared_identifiers(names: Column, wanted: list[str]) -> Column:
    """How many of ``wanted`` are among blank-separated names, whatever the case; each counts once. Null names hold none."""
    have = F.regexp_extract_all(F.lower(F.coalesce(names, F.lit(""))), F.lit("[a-z0-9_$]+"), F.lit(0))
    return F.size(F.array_intersect(have, constant([w.lower() for w in wanted])))


def is_code_grep(command: Column) -> Column:
    """Whether a shell command is a search in code that an index could answer."""
    file_end = command.rlike(fixed.GREP_FILE)
    blocked = command.contains("git grep") | command.rlike(fixed.PIPED_GREP) | command.contains(">") | (command.contains("-l") & ~file_end)
    return ~blocked & (file_end | command.rlike(fixed.QUOTED_GREP))


def grep_pattern(command: Column) -> Column:
    """The quoted pattern of a grep command, or null."""
    found = F.regexp_extract(command, fixed.GREP_PATTERN, 1)
    return F.when(found != "", found)


def deleted_paths(command: Column) -> Column:
    """Distinct arguments of rm, rmdir, git rm and git mv in a shell command."""
    args = F.flatten(F.array(*(F.regexp_extract_all(command, F.lit(p), F.lit(1)) for p in fixed.DELETE_PATTERNS)))
    parts = F.flatten(F.transform(args, lambda a: F.split(a, fixed.ARGUMENT_BREAK)))
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & ~p.startswith("-") & ~p.rlike(fixed.NO_ARGUMENT)))


# Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)

def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


# Endings and what takes their place.
_STEP2 = [x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
_STEP3 = [x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(word: str) -> str:
    """Stem of an English word in lower case; other words come back unchanged."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"
    short = lambda s: _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not short(w[:-1]):
            w = w[:-1]
    if double(w) and w[-1] == "l" and _measure(w) > 1:
        w = w[:-1]
    return w
