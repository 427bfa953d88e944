"""Column builders over texts, token ids and logits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAD, BOS, EOS, DECODER_OFFSET, CTC_OFFSET = 0, 1, 2, 3, 2


def strip(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode composition; no built-in function does it, so Arrow batches of text go through Python. ASCII needs none."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(compose, StringType())(text)).otherwise(text)


def has_khmer(text: Column) -> Column:
    return text.rlike(r"[\x{1780}-\x{17FF}]")


def slug(name: Column) -> Column:
    """File stem with spaces and dots as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[ .]", "_")


def preview(text: Column, confidence: Column) -> Column:
    """Label of at most 50 characters with the confidence in per cent."""
    return F.concat(F.substring(text, 1, 50), F.lit(" ("), F.bround(confidence * 100).cast("int").cast("string"), F.lit("%)"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode(text: Column, vocabulary: Column, offset: int = DECODER_OFFSET, wrap: bool = True) -> Column:
    """Token ids of a text's characters; vocabulary is the array of raw ids by code point, unknown ones are <unk>'s (0)."""
    ids = F.transform(chars(text), lambda c: F.coalesce(F.try_element_at(vocabulary, F.ascii(c) + 1), F.lit(0)) + offset)
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))) if wrap else ids


def decode(ids: Column, characters: Column) -> Column:
    """Text of decoder ids; special ids, <unk> and what is out of range are left out. characters: by raw id."""
    raw = F.transform(F.filter(ids, lambda i: (i > DECODER_OFFSET) & (i - DECODER_OFFSET < F.size(characters))), lambda i: F.element_at(characters, (i - DECODER_OFFSET + 1).cast("int")))
    return F.array_join(raw, "")


def decoder_to_ctc(i: Column, size: int | Column) -> Column:
    """CTC id of a decoder id, with ``size`` characters: special ids are blank, ids out of range the unknown character."""
    raw = i - DECODER_OFFSET
    return F.when(i.isin(PAD, BOS, EOS), 0).when((raw >= 0) & (raw < size), raw + CTC_OFFSET).otherwise(CTC_OFFSET)


def end_bonus(length: Column, target: Column, bias: float = 0.0, boost: float = 0.0, until: int = 2) -> Column:
    """What is added to the end token's log-probability after ``length`` tokens: less ``bias`` while the text is shorter
    than ``until`` (or half the target, if that is less), ``boost`` from the target length on (null or 0: no target)."""
    some = F.coalesce(target, F.lit(0)) > 0
    least = F.when(some, F.least(F.lit(until), F.greatest(F.lit(1), (target * F.lit(0.5)).cast("int")))).otherwise(until)
    return F.when(length < least, F.lit(-bias)).when(some & (length >= target), F.lit(boost)).otherwise(F.lit(0.0))


def pad_to(ids: Column, length: int) -> Column:
    """Cut to ``length`` and filled up with 0."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(0), length - F.size(cut)))


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))


def log_softmax(x: Column) -> Column:
    total = logsumexp(x)
    return F.transform(x, lambda v: v - total)


def fuse(decoder: Column, language: Column, weight: float = 0.35) -> Column:
    return F.zip_with(log_softmax(decoder), log_softmax(language), lambda a, b: a + weight * b)


def length_penalty(n: Column, power: float = 0.8, kind: str = "batch") -> Column:
    """((5 + n) / 6) ** power in the batch search, n ** power in the streaming one and for final scores."""
    n = F.greatest(n, F.lit(1)).cast("double")
    return F.pow((n + 5.0) / 6.0, F.lit(power)) if kind == "batch" else F.pow(n, F.lit(power))


def max_steps(ctc_length: Column, memory: Column, most: int = 512, ratio: float = 1.3, pad: int = 10, memory_ratio: float = 1.0) -> Column:
    """Decoding steps allowed: from the CTC length where there is one, else from the memory's length."""
    return F.least(F.lit(most), F.when(ctc_length > 0, (ctc_length * F.lit(ratio)).cast("int") + pad).otherwise((memory * F.lit(memory_ratio)).cast("int") + pad))


def final_confidence(decoder: Column, ctc: Column) -> Column:
    return F.coalesce(0.6 * decoder + 0.4 * ctc, decoder)


def position_encoding(pos: Column, dim: int) -> Column:
    """Sinusoidal encoding of a position."""
    two = lambda i: F.array(F.sin(pos / F.pow(F.lit(10000.0), i / float(dim))), F.cos(pos / F.pow(F.lit(10000.0), i / float(dim))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim - 2), F.lit(2)), two))


def position_encoding_2d(row: Column, col: Column, dim: int) -> Column:
    """Half of the components for the row, half for the column."""
    return F.concat(position_encoding(row, dim // 2), position_encoding(col, dim // 2))


def fit_words(words: Column, width_of: Column, limit: int | Column, least: int = 2) -> Column:
    """The longest run of first words whose text fits ``limit``, but ``least`` words at least. width_of: the width of the
    text of the first 1, 2, ... words, an array beside ``words``."""
    fits = F.size(F.filter(width_of, lambda w: w <= limit))
    return F.slice(words, 1, F.greatest(fits, F.least(F.lit(least), F.size(words))))


def language_paths(text: Column) -> Column:
    """The map of ``lang:path,lang:path``."""
    pairs = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), ":", 2))
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))
