"""Text scalars: white space, tokens, sentences, names, spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation and connectors of the default splitter, and the three sentence templates.
SENTENCE_ENDS = "。！？；"
LONG_COLON = "："
SOFT_PUNCTUATION = ("，", "、")
CONNECTORS = ("因此", "所以", "然而", "但", "不過", "此外", "同時", "另外", "於是", "因為", "由於", "如果", "雖然", "當", "為了", "也就是說", "即", "例如", "比如", "特別是")
TEMPLATES = ("我覺得{w}很重要。", "最近大家都在討論{w}。", "很多人關心{w}這件事。")

SPACE = r"(?U)\s+"
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Without leading and trailing white space in Unicode's sense, byte order marks included."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def split_words(c: Column) -> Column:
    """Words between Unicode white space; none of an empty text."""
    return F.filter(F.split(strip(c), SPACE), lambda w: w != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def char_tokens(c: Column) -> Column:
    """Each character that is not white space."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\S"), F.lit(0))


def pieces(c: Column) -> Column:
    """Words, runs of white space and single other characters: nothing of the text is lost."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[\p{L}\p{N}]+|\s+|[^\p{L}\p{N}\s]"), F.lit(0))


_TOKENIZERS: dict[str, Callable[[Column], Column]] = {"regex": word_tokens, "space": split_words, "chars": char_tokens, "pieces": pieces}


def register_tokenizer(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Adds a segmenter: a function of a text column that gives array<string>, such as a wrapped pandas UDF."""
    _TOKENIZERS[name] = tokenizer


def tokenize(c: Column, mode: str = "regex") -> Column:
    if mode not in _TOKENIZERS:
        raise ValueError(f"unknown tokenizer {mode}; there are {sorted(_TOKENIZERS)}")
    return _TOKENIZERS[mode](c)


def token_length(c: Column, mode: str = "regex") -> Column:
    return F.size(tokenize(c, mode))


def _class(chars: str) -> str:
    return "".join(f"\\{x}" if x in r"\]^-[&" else x for x in chars)


def split_sentences(c: Column, ends: str = SENTENCE_ENDS, newline: bool = False) -> Column:
    """Sentences with their end mark, stripped, none empty; each repeated mark is a sentence of its own.

    newline: a line feed ends a sentence as well, and belongs to none.
    """
    d = _class(ends)
    find = lambda t: F.regexp_extract_all(t, F.lit(f"[^{d}]*[{d}]|[^{d}]+"), F.lit(0))
    pieces = F.flatten(F.transform(F.split(c, "\n"), find)) if newline else find(c)
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def split_at_colon(sentence: Column, length: Column, limit: int = 80, colon: str = LONG_COLON) -> Column:
    """A sentence of more than limit tokens as its head up to the first colon and the rest, neither empty; else itself."""
    at = F.locate(colon, sentence)
    head, rest = strip(F.substring(sentence, F.lit(1), at - 1)), strip(F.substring(sentence, at + 1, F.length(sentence)))
    parts = F.filter(F.array(F.when(head != "", F.concat(head, F.lit(colon))), F.when(rest != "", rest)), lambda x: x.isNotNull())
    return F.when((at > 0) & (length > limit), parts).otherwise(F.array(sentence))


def file_name(c: Column, limit: int = 120) -> Column:
    """A name without the characters that file systems refuse; "untitled" if nothing is left."""
    name = strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]+', "_"), SPACE, " "))
    name = F.when(F.coalesce(name, F.lit("")) == "", F.lit("untitled")).otherwise(name)
    return F.when(F.length(name) > limit, F.regexp_replace(F.substring(name, 1, limit), r"(?U)\s+$", "")).otherwise(name)


def document_name(doc_id: Column, title: Column) -> Column:
    """The id, else the title, else "untitled"; empty counts as missing."""
    some = lambda c: F.when(c != "", c)
    return file_name(F.coalesce(some(doc_id), some(title), F.lit("untitled")))


def protected_span(tokens: Column, target: Column, window: int = 12) -> Column:
    """struct(l, r), 0-based, around the first occurrence of target; null if there is none."""
    at = F.array_position(tokens, target).cast("int") - 1
    return F.when(at >= 0, F.struct(F.greatest(F.lit(0), at - window).alias("l"), F.least(F.size(tokens) - 1, at + window).alias("r")))


def pick_split(tokens: Column, limit: int, protected: Column | None = None, connectors=CONNECTORS, soft=SOFT_PUNCTUATION) -> Column:
    """The cut (tokens on the left) before a connector or after soft punctuation, anywhere if there is neither.

    Cuts inside the protected span are out; of the others the largest up to limit, else the smallest; null if none.
    """
    every = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    safe = F.filter(every, lambda i: F.get(tokens, i).isin(*connectors) | F.get(tokens, i - 1).isin(*soft))
    cuts = F.when(F.size(safe) > 0, safe).otherwise(every)
    if protected is not None:
        cuts = F.when(protected.isNull(), cuts).otherwise(F.filter(cuts, lambda i: (i < protected["l"]) | (i > protected["r"])))
    return F.coalesce(F.array_max(F.filter(cuts, lambda i: i <= limit)), F.array_min(F.filter(cuts, lambda i: i > limit)))


def substitute(tokens: Column, index: Column, word: Column) -> Column:
    """tokens with the one at a 0-based index replaced."""
    return F.transform(tokens, lambda t, i: F.when(i == index, word).otherwise(t))


def fill_template(template: Column, word: Column) -> Column:
    return F.replace(template, F.lit("{w}"), word)


def word_start(sentence: Column, word: Column) -> Column:
    """0-based place of the first match, -1 if there is none."""
    return F.instr(sentence, word) - 1


def first_overlap(offsets: Column, start: Column, end: Column) -> Column:
    """Index of the first sub-token (struct s, e) that overlaps [start, end); empty ones don't count; else 0."""
    hit = F.transform(offsets, lambda o, i: F.when((o["e"] > o["s"]) & (o["e"] > start) & (o["s"] < end), i))
    return F.coalesce(F.array_min(F.filter(hit, lambda x: x.isNotNull())), F.lit(0))
