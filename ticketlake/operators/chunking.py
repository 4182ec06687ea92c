"""Knowledge-base chunking (K1-K3) with higher-order array functions.

Everything runs per document inside one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.text import strip_unicode, words

# Chunk size ceiling and minimum size.
CHUNK_WORDS = 120
MIN_CHUNK_WORDS = 20
# chunk_id = doc_id * CHUNK_ID_STRIDE + position of the chunk in its document.
CHUNK_ID_STRIDE = 1_000_000


def split_paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """K1: split on blank lines, strip each piece, drop empty pieces."""
    import re
    return F.filter(F.transform(F.split(text, re.escape(sep), -1), strip_unicode), lambda p: p != "")


def pack_sentences(para: Column, max_words: int = CHUNK_WORDS) -> Column:
    """K2: a paragraph within the limit is kept verbatim; a longer one is cut into
    sentences (``?``/``!`` end sentences too) and packed greedily; a sentence
    longer than the limit is never cut."""
    sentences = F.split(F.replace(F.replace(para, F.lit("?"), F.lit("?.")), F.lit("!"), F.lit("!.")),
                        r"\. ", -1)
    init = F.struct(F.array().cast("array<string>").alias("chunks"),
                    F.array().cast("array<string>").alias("cur"))

    def step(acc, sw):
        flush = (F.size(acc["cur"]) + F.size(sw) > max_words) & (F.size(acc["cur"]) > 0)
        return F.when(flush, F.struct(
            F.array_append(acc["chunks"], F.array_join(acc["cur"], " ")).alias("chunks"),
            sw.alias("cur"))).otherwise(F.struct(
                acc["chunks"].alias("chunks"), F.concat(acc["cur"], sw).alias("cur")))

    def finish(acc):
        return F.when(F.size(acc["cur"]) > 0,
                      F.array_append(acc["chunks"], F.array_join(acc["cur"], " "))).otherwise(acc["chunks"])

    packed = F.aggregate(F.transform(sentences, words), init, step, finish)  # each sentence is cut once
    return F.when(F.size(words(para)) <= max_words, F.array(para)).otherwise(packed)


def chunk_texts(text: Column, max_words: int = CHUNK_WORDS, min_words: int = MIN_CHUNK_WORDS,
                sep: str = "\n\n") -> Column:
    """All surviving chunk texts of one document, in order."""
    per_para = F.transform(split_paragraphs(text, sep), lambda p: pack_sentences(p, max_words))
    return F.filter(F.flatten(per_para), lambda c: F.size(words(c)) >= min_words)


def chunk_kb(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", max_words: int = CHUNK_WORDS,
             min_words: int = MIN_CHUNK_WORDS, sep: str = "\n\n") -> DataFrame:
    """K3: one row per surviving chunk: ``(chunk_id, doc_id, chunk_no, source, text)``.

    Survivors are numbered consecutively within their document (``chunk_no``);
    ``chunk_id`` combines document and position, so ids are stable and need no
    global ordering pass.
    """
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                           F.posexplode(chunk_texts(F.col(text_col), max_words, min_words, sep))
                           .alias("chunk_no", "text"))
    return exploded.select(
        (F.col("doc_id") * CHUNK_ID_STRIDE + F.col("chunk_no")).alias("chunk_id"),
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "source", "text")
