"""Source divergence audit: how far each source's words lie from the other sources of its language.

Tasks count terms of whole texts per (lang, source) and pre-aggregate them.
The counts are dealt by a hash of (lang, term) into shards, so that all that is
known of a term meets in one shard, however many texts hold it; DuckDB sums a
shard's counts from a stream of batches and keeps the terms of enough
documents.  Sums of the kept counts give each group's smoothed shares.  A second
vectorised pass over the shards, now with these sums, gives each shard's best
terms a group and its partial sums of every pair of sources; Spark merges the
sums and ranks.

A pair's distance is a sum over all kept terms, most of which most sources
lack.  A term that neither has adds the same number always, a term that one has
adds what follows from its count alone; so shards only join the counts of
terms that both sources have, and the rest comes from a histogram of counts.

All arithmetic is on whole numbers.  Pairs of sources of a language are the
result itself; nothing else is squared.

Defined cases: null text, lang and source are empty; a group whose documents
have no kept term has all shares at their floor; without kept terms distances
are 0 and there are no terms; repeated rows are documents of their own; ties go to
the item that sorts first by its UTF-8 bytes; an empty table gives no rows; other
columns are not read.  One text is held whole by a worker, at some twenty times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import LOWER_ASCII, slices, text_buffer
from .shared import pieces_for, written

LEAST_DOCS, BEST, PLUS = 30, 50, 5
SCALE = 1_000_000_000
#: Bytes of text a shard is made for; bytes of text read at once.
SHARD_BYTES, SLICE_BYTES = 16 << 20, 16 << 20

#: Bytes of terms, lower-cased; all else separates.
_TERM_BYTES = LOWER_ASCII.copy()
_TERM_BYTES[[b for b in range(128) if not chr(b).isalpha()]] = 0x20

PARTIAL = "lang string, source string, term string, n long, docs long"
COUNTS = "shard int, lang string, source string, term string, n long, lead int"
FOUND = "part string, lang string, source string, item string, value long"


def _slice_counts(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Counts of the terms of some texts by their group."""
    n = len(offsets) - 1
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(_TERM_BYTES[data]))
    words = pc.ascii_split_whitespace(text)
    groups = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    group = np.asarray(pc.rank(lang, tiebreaker="dense")) * n + np.asarray(pc.rank(source, tiebreaker="dense"))
    _, lead, group = np.unique(group, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(n), np.asarray(pc.list_value_length(words)))
    coded = words.flatten().dictionary_encode()
    code, n_terms = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    # One sort by group, term and document; a document is in one group.
    key = (group[doc] * n_terms + code) * n + doc
    key.sort()
    of = key // max(1, n)
    new = np.flatnonzero(np.diff(of, prepend=-1))
    first = np.cumsum(np.diff(key, prepend=-1) != 0)
    at = np.append(new, len(key))
    docs = np.diff(np.append(first[new], first[-1] + 1 if len(key) else 0)) if len(new) else new
    group, term = of[new] // n_terms, coded.dictionary.take(pa.array(of[new] % n_terms)).cast(pa.string())
    some = groups.take(pa.array(lead[group]))
    out = pa.RecordBatch.from_arrays([some.field(0), some.field(1), term, pa.array(np.diff(at)), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
    return out.filter(pc.not_equal(term, ""))


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> PARTIAL rows, summed over some megabytes of text each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (pc.fill_null(batch.column(k).cast(pa.string()), "") for k in (1, 2))
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets, SLICE_BYTES):
                own = offsets[lo : hi + 1] - offsets[lo]
                yield _slice_counts(lang.slice(lo, hi - lo), source.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], own)

    return docs.select("text", "lang", "source").mapInArrow(count, PARTIAL)


def _over_shard(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: str) -> Iterator[pa.RecordBatch]:
    """The result of DuckDB SQL over one shard, which it reads batch by batch as ``s``."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.register("given", pa.RecordBatchReader.from_batches(schema, batches))
    con.execute("CREATE TABLE s AS SELECT * FROM given")
    yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=1 << 16)
    con.close()


def kept_counts(partial: DataFrame, shards: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """COUNTS rows of the terms in at least ``least_docs`` documents of their language; lead marks one row a (lang, term)."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    sql = f"""
        SELECT shard, lang, source, term, n, (row_number() OVER w = 1)::INT AS lead FROM (
          SELECT any_value(shard) AS shard, lang, source, term, sum(n)::BIGINT AS n, sum(sum(docs)) OVER (PARTITION BY lang, term) AS docs FROM s GROUP BY lang, source, term)
        WHERE docs >= {least_docs} WINDOW w AS (PARTITION BY lang, term ORDER BY source)"""
    dealt = partial.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "*")
    return dealt.repartitionById(shards, "shard").mapInArrow(lambda batches: _over_shard(batches, schema, sql), COUNTS)


def _share(count: str, total: str) -> Column:
    """p of a count in a group of ``total`` kept occurrences; v kept terms."""
    return F.expr(f"1 + ({SCALE}BD * cast({count} + {PLUS} as decimal(20, 0))) div cast({total} + {PLUS} * v as decimal(20, 0))")


def group_totals(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, floor) of every group; floor is the share of a term that it lacks."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    rows = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    rows = rows.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "v")))
    return rows.withColumn("floor", F.when(F.col("v") > 0, _share("0", "total")).otherwise(zero))


def shard_findings(counts: DataFrame, totals: DataFrame, shards: int, best: int = BEST) -> DataFrame:
    """FOUND rows of each shard: its best terms a group, and its partial sums of pairs of sources (source < item).

    A partial sum holds what shared terms add beyond the sums of either source alone.
    """
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), *((c, pa.int64()) for c in ("n", "lang_total", "v", "p", "floor"))])
    sql = f"""
        WITH l AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (sum(n) + {PLUS})) // (any_value(lang_total) + {PLUS} * any_value(v)))::BIGINT AS q FROM s GROUP BY lang, term),
        r AS (SELECT lang, source, term, p - q AS f, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS k FROM s JOIN l USING (lang, term) WHERE p > q)
        SELECT 'term' AS part, lang, source, term AS item, f AS value FROM r WHERE k <= {best}
        UNION ALL
        SELECT 'pair', a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.floor) - abs(a.floor - b.p) + abs(a.floor - b.floor))::BIGINT
        FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL"""
    rows = counts.join(totals, ["lang", "source"]).withColumn("p", _share("n", "total"))
    dealt = rows.select("shard", "lang", "source", "term", "n", "lang_total", "v", "p", "floor").repartitionById(shards, "shard")
    return dealt.mapInArrow(lambda batches: _over_shard(batches, schema, sql), FOUND)


def pair_sums(counts: DataFrame, totals: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source to each other one of its language, both ways round."""
    other = totals.select("lang", F.col("source").alias("item"), F.col("floor").alias("other_floor"))
    # What the terms of one source add, whatever the other one has of them: it hangs on their count alone.
    same = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(totals, ["lang", "source"]).withColumn("p", _share("n", "total"))
    apart = F.abs(F.col("floor") - F.col("other_floor"))
    gap = F.abs(F.col("p") - F.col("other_floor")) - apart
    alone = same.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * gap).alias("value"))
    none = totals.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * apart).alias("value"))
    both = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return none.unionByName(turned(alone.unionByName(both))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value, rank)."""
    shards = pieces_for(docs, SHARD_BYTES)
    counts = written(kept_counts(term_counts(docs), shards, least_docs), "kept-counts")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    totals = written(group_totals(docs.select(name("lang"), name("source")).distinct(), counts), "totals")
    found = written(shard_findings(counts, totals, shards, best), "shard-findings")
    pairs = pair_sums(counts, totals, found).select(F.lit("pair").alias("part"), "lang", "source", "item", "value")
    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first))
    terms = ranked(found.where("part = 'term'")).where(F.col("rank") <= best)
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
