"""Frequency of every distinct value or term, by a range-partitioned sort of terms and records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pairs import clean_labels, image_key
from tessera.session import cut_lineage, read_table, task_count

WORDS = "[0-9A-Za-z가-힣]+"
POSTINGS = "field string, term string, bucket int, recs array<long>, uses long"


def caption_terms(text: Column) -> Column:
    """The longest runs of ASCII digits, ASCII letters and Hangul syllables of a text, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORDS), 0), lambda x: F.lower(x))


def label_uses(labels: Column) -> Column:
    """Stripped, lower-cased labels without nulls and blanks, repeated ones as often as they are there."""
    stripped = F.transform(labels, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of rows with equal ``keys``."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _postings(buckets: int, flush: int, batches):
    """Sorted lists of record ids by term and bucket, of as many rows at a time as fit ``flush``."""
    held: list[pa.RecordBatch] = []
    size = 0

    def lists():
        t = pa.Table.from_batches(held).combine_chunks()
        rows = t.num_rows
        terms = t.column("terms").combine_chunks()
        lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fields = t.column("field").combine_chunks().dictionary_encode()
        field = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rec = t.column("rec").combine_chunks().to_numpy(zero_copy_only=False)
        words = terms.flatten().dictionary_encode()
        # the term -1 stands for the record itself, so that records without terms count as well
        term = np.concatenate([words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(rows, -1)])
        rec_of = np.concatenate([np.repeat(rec, lengths), rec])
        field_of = np.concatenate([np.repeat(field, lengths), field])
        bucket = ((rec_of.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(rec_of), dtype=np.int64)
        group = ((term + 1) * len(fields.dictionary) + field_of) * buckets + bucket
        order = np.lexsort((rec_of, group))
        group, rec_of, term, field_of, bucket = (x[order] for x in (group, rec_of, term, field_of, bucket))
        single = _runs(group, rec_of)
        starts = _runs(group)
        offsets = np.append(np.searchsorted(single, starts), len(single)).astype(np.int32)
        uses = np.diff(np.append(starts, len(group)))
        names = words.dictionary.take(pa.array(term[starts], mask=term[starts] < 0))
        return pa.RecordBatch.from_arrays(
            [fields.dictionary.take(pa.array(field_of[starts])), names, pa.array(bucket[starts].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rec_of[single])), pa.array(uses)],
            names=["field", "term", "bucket", "recs", "uses"],
        )

    def cut(batch):
        for s in range(0, batch.num_rows, 20_000):
            yield batch.slice(s, 20_000)

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += len(b.column("terms").flatten()) + b.num_rows
        if size >= flush:
            yield from cut(lists())
            held, size = [], 0
    if held:
        yield from cut(lists())


def _scan(batches):
    """Run-length scan of postings sorted by field, term and bucket: distinct records and uses of each run."""
    carry = None
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("records", pa.int64()), ("uses", pa.int64())])

    def codes(t):
        out = []
        for name in ("field", "term", "bucket"):
            coded = t.column(name).combine_chunks().dictionary_encode()
            out.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False))
        return out

    def counted(t):
        starts = _runs(*codes(t))
        recs = t.column("recs").combine_chunks()
        lengths = recs.value_lengths().to_numpy(zero_copy_only=False)
        run = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows))), lengths)
        flat = recs.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((flat, run))
        run, flat = run[order], flat[order]
        records = np.bincount(run[_runs(run, flat)], minlength=len(starts)) if len(run) else np.zeros(len(starts), dtype=np.int64)
        uses = np.add.reduceat(t.column("uses").to_numpy(), starts)
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([t.column("field").combine_chunks().take(at), t.column("term").combine_chunks().take(at), pa.array(records), pa.array(uses)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*carry, b] if carry else [b]).combine_chunks()
        last = int(_runs(*codes(t))[-1])
        if last:
            yield counted(t.slice(0, last))
        carry = t.slice(last).to_batches()
    if carry:
        yield counted(pa.Table.from_batches(carry))


def term_frequencies(df: DataFrame, record_col: str | Column, terms_col: str | Column, field: str = "term") -> DataFrame:
    """Rows for :func:`count_terms`: (field, rec, terms), each different row of a record once."""
    rec = F.col(record_col) if isinstance(record_col, str) else record_col
    terms = F.col(terms_col) if isinstance(terms_col, str) else terms_col
    rows = df.select(rec.alias("rec"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).filter("rec is not null").dropDuplicates(["rec", "terms"])
    whole = dict(rows.dtypes)["rec"] in ("tinyint", "smallint", "int", "bigint")
    key = F.col("rec").cast("long") if whole else F.xxhash64("rec")
    return rows.select(F.lit(field).alias("field"), key.alias("rec"), F.filter("terms", lambda x: x.isNotNull()).alias("terms"))


def count_terms(*parts: DataFrame, rare_below: int = 3, common_above: int = 5, buckets: int = 64, flush: int = 1_500_000) -> DataFrame:
    """Uses and records of every term of every field: (field, term, uses, records, n_records, mark).

    ``parts`` come from :func:`term_frequencies`. ``uses`` counts all occurrences, a row that repeats another
    row of its record counting once; ``records`` counts distinct records; ``n_records`` counts the records of
    the field, those without terms included. ``mark`` is 'rare' for terms in fewer than ``rare_below`` records,
    else 'common' if ``common_above * records > n_records``, else null; a term that is both is marked rare.
    Null records and null terms are left out; the empty string is a term. Empty tables give no rows.

    Each task first turns its rows into sorted lists of record ids by term and bucket of records; these are
    range-partitioned and sorted by (field, term, bucket), so that a term in a third of all records lies in
    many partitions, and scanned for runs. A record that isn't a number goes by its 64-bit hash: two records
    that collide count as one for the terms they share, which at 10^9 records is expected to touch less than
    one of them.
    """
    spark = parts[0].sparkSession
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    tasks = task_count(spark)
    buckets = 1 << (max(buckets, tasks) - 1).bit_length()
    lists = rows.mapInArrow(lambda batches: _postings(buckets, flush, batches), POSTINGS)
    ordered = lists.repartitionByRange(tasks, "field", "term", "bucket").sortWithinPartitions("field", "term", "bucket")
    runs = ordered.mapInArrow(_scan, "field string, term string, records long, uses long")
    counts = cut_lineage(runs.groupBy("field", "term").agg(F.sum("records").alias("records"), F.sum("uses").alias("uses")))
    totals = counts.filter("term is null").select("field", F.col("records").alias("n_records"))  # a row for each field
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_above > F.col("n_records"), "common")
    return counts.filter("term is not null").join(F.broadcast(totals), "field").select("field", "term", "uses", "records", "n_records", mark.alias("mark"))


def frequencies_of_collection(spark, sf_dir: str) -> DataFrame:
    """Frequencies of the labels of the images and of the words of the captions."""
    records, hits = read_table(spark, sf_dir, "graph_records"), read_table(spark, sf_dir, "folder_hits")
    return count_terms(
        term_frequencies(records, image_key(F.col("image_path")), label_uses(F.col("classes")), "classes"), term_frequencies(hits, "hit_id", caption_terms(F.col("caption")), "caption")
    )


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Labels and caption terms that are too rare or too common."""
    return frequencies_of_collection(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")
