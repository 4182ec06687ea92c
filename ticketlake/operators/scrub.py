"""Privacy scrubbing and text normalisation over whole tables.

One ``scrub_table`` transform serves batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.session import bound_batches, cut_lineage

STRUCTURED_MASKS = {
    "Customer Name": "[REDACTED_PERSON]",
    "Customer Email": "[REDACTED_EMAIL]",
}
TEXT_COLUMNS = ["Ticket Subject", "Ticket Description", "Resolution"]


def entity_pattern(names: list[str]) -> str:
    """One alternation, longest name first, whole words only."""
    import re
    alts = sorted({n for n in names if n}, key=lambda s: (-len(s), s))
    return r"\b(?:" + "|".join(re.escape(a).replace(r"\ ", r"\s+") for a in alts) + r")\b"


# Names in one pattern; a larger gazetteer is applied in several, the longest names first.
PATTERN_NAMES = 5000


def entity_patterns(names: list[str]) -> list[str]:
    alts = sorted({n for n in names if n}, key=lambda s: (-len(s), s))
    return [entity_pattern(alts[i:i + PATTERN_NAMES]) for i in range(0, len(alts), PATTERN_NAMES)]


def redact_entities(col: Column, gazetteer: dict[str, list[str]]) -> Column:
    """Dictionary entity redaction, one alternation per label.

    GPE and LOC share the location tag.  Labels are applied in a fixed order
    (PERSON, ORG, GPE, LOC) so overlapping names resolve deterministically.
    """
    out = col
    for label in ("PERSON", "ORG", "GPE", "LOC"):
        for pattern in entity_patterns(gazetteer.get(label) or []):
            out = F.regexp_replace(out, pattern, tx._java_replacement(tx.REDACTION_TAGS[label]))
    return out


ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC")
# Names that may be broadcast, and the parts into which a hot key is dealt beyond that.
BROADCAST_NAMES = 1_000_000
NAME_SALTS = 16

# A text as units: runs of word characters, runs of blanks, single other characters.
_UNITS = r"([\w\p{L}\p{N}]+|[ \t\n\x0B\f\r]+|[\s\S])"


def gazetteer_table(spark: SparkSession, gazetteer: dict[str, list[str]]) -> DataFrame:
    """A dictionary of names as the table ``(label, name)``."""
    rows = [(label, n) for label, names in gazetteer.items() for n in names]
    return spark.createDataFrame(rows, "label string, name string")


def _units(text: Column) -> Column:
    """The text's units, every run of blanks as one space."""
    return F.transform(F.regexp_extract_all(text, F.lit(_UNITS), 1), lambda u: F.when(u.rlike(r"^[ \t\n\x0B\f\r]"), F.lit(" ")).otherwise(u))


def _rewrite(raw: list[str] | None, found: list | None) -> tuple[str | None, int]:
    """The text with its matches replaced.  Labels take their matches in order, each from left to
    right, the longest first; a unit is taken once.  Time grows with units and matches only."""
    if raw is None:
        return None, 0
    taken, cut = bytearray(len(raw)), {}
    by_label: dict[int, list] = {}
    for m in found or ():
        by_label.setdefault(m["label_no"], []).append((m["pos"], -m["chars"], m["size"]))
    for label in sorted(by_label):
        for pos, _, size in sorted(by_label[label]):
            if not any(taken[pos:pos + size]):
                taken[pos:pos + size] = b"\1" * size
                cut[pos] = (size, label)
    out, at = [], 0
    while at < len(raw):
        if at in cut:
            size, label = cut[at]
            out.append(tx.REDACTION_TAGS[ENTITY_LABELS[label]])
            at += size
        else:
            out.append(raw[at])
            at += 1
    return "".join(out), len(cut)


def _numbered(df: DataFrame) -> DataFrame:
    """``(_row, _in)``: the rows as structs with a number each, written once, so that no column can clash."""
    return cut_lineage(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"))
                       .withColumn("_row", F.monotonically_increasing_id())).repartition("_row")


def _candidates(units: DataFrame, sizes: list[int], first: dict[str, list[int]] | None) -> DataFrame:
    """``(_row, pos, size, key, _before, _first, _last, _after)``: the runs of ``(_row, u)`` that are as long as some
    name and, where ``first`` is given, begin with the first unit of a name of that length; with the units at and
    beyond both ends.  A batch's units are compared as numbers, so texts cost time by their units only."""
    import numpy as np
    bound_batches(units.sparkSession)
    lookup = units.sparkSession.sparkContext.broadcast(first)
    ends = ("_before", "_first", "_last", "_after")

    def find(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        known = lookup.value
        for b in batches:
            coded = b.column(1).flatten().dictionary_encode()
            names = [" " if u[0] in " \t\n\x0b\f\r" else u for u in coded.dictionary.to_pylist()]
            code = coded.indices.to_numpy(zero_copy_only=False)
            length = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            end = np.cumsum(length)
            words = pa.array(names, pa.string())

            def at(i, ok):
                return words.take(pa.array(np.where(ok, code[np.clip(i, 0, max(0, len(code) - 1))], 0), mask=~ok))
            for size in sizes:
                flag = np.array([known is None or size in known.get(u, ()) for u in names], dtype=bool)
                i = np.flatnonzero(flag[code])
                i = i[i + size <= end[row[i]]]
                for part in (i[k:k + (1 << 16)] for k in range(0, len(i), 1 << 16)):
                    r, inside = row[part], np.ones(len(part), bool)
                    pos = part - (end[r] - length[r])
                    runs = [at(part + k, inside) for k in range(size)]
                    key = runs[0] if size == 1 else pc.binary_join_element_wise(*runs, "")
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(r)), pa.array(pos, pa.int32()), pa.array(np.full(len(part), size), pa.int32()), key,
                         at(part - 1, pos > 0), runs[0], runs[-1], at(part + size, part + size < end[r])],
                        names=["_row", "pos", "size", "key", *ends])
    return units.mapInArrow(find, "_row long, pos int, size int, key string, " + ", ".join(f"{c} string" for c in ends))


def redact_entities_table(df: DataFrame, text_col: str, names: DataFrame, hits_col: str | None = None) -> DataFrame:
    """P8 for a gazetteer ``(label, name)`` of any size: the rows of ``df`` with ``text_col`` redacted
    and, if asked for, the number of names found.

    Every run of units that is as long as some name and begins like one is looked up in the names by an
    equi-join (beyond a million names: every run that is as long as one), so no pattern holds a name; matches
    then come back to their row.  As in the pattern form names are whole words, blanks inside them match any
    run of blanks, the longest name at the leftmost place wins, and PERSON, ORG, GPE and LOC choose in this
    order.  Texts are shuffled once.  Rows need no key.
    """
    labels = F.array(*[F.lit(x) for x in ENTITY_LABELS])
    known = (names.select((F.array_position(labels, F.col("label")) - 1).cast("int").alias("label_no"), F.col("name").alias("_name"))
             .where((F.col("label_no") >= 0) & (F.coalesce("_name", F.lit("")) != ""))
             .select("label_no", F.length("_name").alias("chars"), _units(F.col("_name")).alias("u"))
             .groupBy(F.array_join("u", "").alias("key"), F.size("u").alias("size"), "label_no")
             .agg(F.max("chars").alias("chars"), F.min(F.get("u", F.lit(0))).alias("begin")))
    known = cut_lineage(known)
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # lengths of names, not names
    few = known.count() <= BROADCAST_NAMES
    first = {r[0]: r[1] for r in known.groupBy("begin").agg(F.collect_set("size")).collect()} if few else None
    known = known.drop("begin")
    rows = _numbered(df)
    value = F.col(f"_in.`{text_col}`")
    raw = F.regexp_extract_all(value, F.lit(_UNITS), 1)

    def is_word(c):
        return F.coalesce(F.col(c).rlike(r"^[\p{L}\p{N}_]"), F.lit(False))
    # a name begins and ends at borders of words
    runs = (_candidates(rows.where(value.isNotNull()).select("_row", raw.alias("u")), sizes, first)
            .where((is_word("_before") != is_word("_first")) & (is_word("_last") != is_word("_after")))
            .select("_row", "pos", "size", "key"))
    on = ["key", "size"]
    if few:
        hits = runs.join(F.broadcast(known), on)
    else:  # a name that is a common word is dealt to several tasks
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
        hits = runs.withColumn("_salt", F.pmod(F.xxhash64("_row", "pos"), F.lit(NAME_SALTS)).cast("int")).join(
            salted.hint("shuffle_hash"), [*on, "_salt"])
    found = hits.groupBy("_row").agg(F.collect_list(F.struct("pos", "size", "label_no", "chars")).alias("_found"))  # one text's
    joined = rows.join(found, "_row", "left")
    # texts without a name are not sent to Python
    some = joined.withColumn("_new", F.udf(_rewrite, "text string, hits int", useArrow=True)(
        F.when(F.col("_found").isNotNull(), raw), F.col("_found")))
    text = F.when(F.col("_found").isNotNull(), F.col("_new.text")).otherwise(value)
    columns = [text.alias(c) if c == text_col else F.col(f"_in.`{c}`") for c in df.columns]
    if hits_col:
        columns.append(F.coalesce("_new.hits", F.lit(0)).cast("long").alias(hits_col))
    return some.select(*columns)


def scrub_full(col: Column, gazetteer: dict[str, list[str]] | None = None) -> Column:
    """Regex chain, then entity redaction."""
    out = tx.scrub_regex(col)
    if gazetteer:
        out = redact_entities(out, gazetteer)
    return out


def normalize_full(col: Column, lemma_map: Column | None = None) -> Column:
    """Unescape -> lower -> punctuation to space -> lemmatise (the scrubber's normalise)."""
    return tx.lemmatize(tx.normalize_text(tx.html_unescape(col)), lemma_map)


def mask_columns(df: DataFrame, masks: dict[str, str] | None = None) -> DataFrame:
    """P10: whole identifier columns become a constant tag; nulls stay null."""
    masks = STRUCTURED_MASKS if masks is None else masks
    for c, tag in masks.items():
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.lit(tag)))
    return df


def scrub_table(df: DataFrame, text_columns: list[str] | None = None,
                masks: dict[str, str] | None = None,
                gazetteer: dict[str, list[str]] | DataFrame | None = None,
                lemma_map: Column | None = None,
                drop_id: str | None = None,
                age_column: str | None = "Customer Age") -> DataFrame:
    """Whole-table scrub, the same plan for a batch or a stream.

    Age is bucketed, identifier columns masked, each free-text column goes
    through regex + entity redaction and then normalisation; null text passes.
    ``gazetteer``: a dictionary of names, or a table ``(label, name)`` of any size.
    """
    text_columns = TEXT_COLUMNS if text_columns is None else text_columns
    if drop_id and drop_id in df.columns:
        df = df.drop(drop_id)
    if age_column and age_column in df.columns:
        df = df.withColumn(age_column, tx.age_bucket(F.col(age_column)))
    df = mask_columns(df, masks)
    for c in text_columns:
        if c in df.columns:
            # stage the redacted text so the normaliser reads a column, not a copy of the chain
            if isinstance(gazetteer, DataFrame):
                df = redact_entities_table(df.withColumn(c, tx.scrub_regex(F.col(c))), c, gazetteer)
            else:
                df = df.withColumn(c, scrub_full(F.col(c), gazetteer))
            df = df.withColumn(c, normalize_full(F.col(c), lemma_map))
    return df


def scrub_stats(df: DataFrame, text_columns: list[str],
                masks: dict[str, str] | None = None,
                gazetteer: dict[str, list[str]] | DataFrame | None = None,
                lemma_map: Column | None = None) -> DataFrame:
    """One-row totals: regex hits, entity hits, cells changed.

    Entities are found and counted by ``redact_entities_table``, for any number of names.  Hits are counted at each step of the chain on the already rewritten text;
    a text cell counts as changed when its final form differs from the input.
    """
    masks = STRUCTURED_MASKS if masks is None else masks
    names = gazetteer_table(df.sparkSession, gazetteer) if isinstance(gazetteer, dict) else gazetteer
    regex_hits, ner_hits, changed = [], [], []
    for j, c in enumerate(text_columns):
        cur = f"_s{j}"
        df = df.withColumn(cur, F.col(c))
        for label, pat in tx.PII_PATTERNS:
            df = df.withColumn(f"_h{j}_{label}", F.coalesce(F.regexp_count(F.col(cur), F.lit(pat)), F.lit(0)))
            df = df.withColumn(cur, tx.redact(F.col(cur), label))
            regex_hits.append(F.col(f"_h{j}_{label}"))
        if names is not None:
            df = redact_entities_table(df, cur, names, f"_n{j}")
            ner_hits.append(F.col(f"_n{j}"))
        df = df.withColumn(cur, normalize_full(F.col(cur), lemma_map))
        changed.append(F.when(F.col(c).isNotNull() & (F.col(cur) != F.col(c)), 1).otherwise(0))
    for c in masks:
        if c in df.columns:
            changed.append(F.when(F.col(c).isNotNull() & (F.col(c) != F.lit(masks[c])), 1).otherwise(0))
    return df.agg(
        F.sum(sum(regex_hits, F.lit(0))).cast("long").alias("regex_matches"),
        F.sum(sum(ner_hits, F.lit(0))).cast("long").alias("ner_matches"),
        F.sum(sum(changed, F.lit(0))).cast("long").alias("cells_changed"))


def lemma_table(lemmas: DataFrame) -> DataFrame:
    """The dictionary ``(word, lemma)`` with lower-case words, each once (the smallest lemma of several)."""
    return (lemmas.where(F.col("word").isNotNull() & F.col("lemma").isNotNull())
            .groupBy(F.lower("word").alias("word")).agg(F.min("lemma").alias("lemma")))


def lemmatize_join(df: DataFrame, text_col: str, lemmas: DataFrame, out_col: str = "lemmatized") -> DataFrame:
    """P14 for a dictionary ``(word, lemma)`` of any size: ``df`` with ``out_col``, null texts null.

    Words that occur are looked up once each: the corpus's distinct words join the dictionary, and the
    hits (few of either) come back to the texts' words by a join that is broadcast up to
    ``BROADCAST_NAMES`` rows and salted beyond, so a frequent word is no hot key.  Rows need no key.
    """
    rows, value = _numbered(df), F.col(f"_in.`{text_col}`")
    toks = rows.select("_row", F.posexplode(tx.words(tx.strip_unicode(value))).alias("pos", "word"))
    known = cut_lineage(toks.select("word").distinct().join(lemma_table(lemmas), "word"))
    if known.count() <= BROADCAST_NAMES:
        joined = toks.join(F.broadcast(known), "word", "left")
    else:
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
        joined = toks.withColumn("_salt", F.pmod(F.xxhash64("_row", "pos"), F.lit(NAME_SALTS)).cast("int")).join(
            salted.hint("shuffle_hash"), ["word", "_salt"], "left")
    rebuilt = (joined.groupBy("_row")  # one group is one text's words
               .agg(F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("w")))),
                   lambda s: s["w"]), " ").alias("_text")))
    text = F.when(value.isNotNull(), F.coalesce("_text", F.lit("")))
    return rows.join(rebuilt, "_row", "left").select(*[F.col(f"_in.`{c}`") for c in df.columns], text.alias(out_col))
