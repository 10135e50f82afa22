"""Source divergence audit by Arrow compute.

Three steps, each a pass over columns in Arrow:

1. *Partial counts.* ``mapInArrow`` lower-cases a batch of texts (``ascii_lower``),
   splits it (``split_pattern_regex``), names its terms by numbers
   (``dictionary_encode``) and counts them (hash ``group_by``): one row for each
   group and term of a task, not of a document.
2. *Merged shards.* Partial rows meet by language and term, sorted, and are merged
   a run of terms at a time.  A shard keeps one row a kept term: its sources and
   their counts as two lists.
3. *Divergences.* A shard's rows become a matrix of sources by terms; a task hands
   on sums of differences for each pair of sources, and each group's excess terms.

All arithmetic is on integers.  A share ``1e9 * a // d`` is divided in three steps
of a thousand, so that counts up to 9e15 stay exact in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.llm.common import bounded_batches, materialize
from askweave.session import broadcast_if_fits

#: What stands between terms: everything of ASCII but letters.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a term must occur in to be kept.
MIN_DOCS = 30
#: Added to each count, so that absent terms have a share.
PRIOR = 5
#: Terms reported for a group.
TOP_TERMS = 50
#: Rows of partial counts and cells of pair sums that a task holds before it hands them on.
HELD_ROWS = 1 << 19
HELD_CELLS = 1 << 22
#: Sources of a language whose sums with all others are taken at once.
SOURCE_BLOCK = 512
#: The term of the row that only tells that a group occurs; no term is empty.
NO_TERM = ""

_KEYS = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SHARDS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _summed(table: pa.Table) -> pa.Table:
    out = table.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS)


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term of each group of a batch, and a row with ``NO_TERM`` for each group."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=SEPARATOR)
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(terms, "")
    coded = terms.filter(real).dictionary_encode()
    in_row = pa.table({"row": rows.filter(real), "code": coded.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    group = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    counted = group.take(in_row.column("row")).append_column("code", in_row.column("code")).append_column("n", in_row.column("count_all"))
    counted = counted.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    named = pa.table([counted["lang"], counted["source"], coded.dictionary.take(counted["code"].combine_chunks()), counted["n_sum"], counted["n_count"]], schema=_COUNTS)
    present = group.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    zero = pa.array(np.zeros(len(present), np.int64))
    return pa.concat_tables([named, pa.table([present["lang"], present["source"], pa.array([NO_TERM] * len(present), pa.string()), zero, present["count_all"]], schema=_COUNTS)])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch_counts(batch))
            rows += held[-1].num_rows
        if rows >= HELD_ROWS:
            merged = _summed(pa.concat_tables(held))
            held, rows = [merged], merged.num_rows
            if rows >= HELD_ROWS // 2:
                yield from merged.to_batches(1 << 16)
                held, rows = [], 0
    if held:
        yield from _summed(pa.concat_tables(held)).to_batches(1 << 16)


def _shards(min_docs: int):
    def shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
        counts = _summed(table)
        spread = counts.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")])
        keep = pc.or_(pc.greater_equal(spread["docs_sum"], min_docs), pc.equal(spread["term"], NO_TERM))
        spread = spread.filter(keep)
        yield from pa.table([spread["lang"], spread["term"], spread["source_list"], spread["n_list"]], schema=_SHARDS).to_batches(1 << 12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(_COUNTS.names).cast(_COUNTS)
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 1 << 15:
                continue
            last = held.slice(held.num_rows - 1).to_pylist()[0]
            same = pc.and_(pc.equal(held["lang"], last["lang"]), pc.equal(held["term"], last["term"]))
            start = pc.index(same, True).as_py()  # rows are sorted: what follows may go on in the next batch
            if start:
                yield from shard(held.slice(0, start))
                held = held.slice(start).combine_chunks()
            else:  # one term of more rows than are held: merge them and go on
                held = _summed(held)
        if held is not None:
            yield from shard(held)

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + 1e9 * (count + PRIOR) // total`` in whole numbers."""
    out, rest = np.divmod(count + PRIOR, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of part ``pair`` with partial sums (the source before the item), and all rows of part ``term``."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    names: dict[str, list[str]] = {}

    def pairs() -> Iterator[pa.RecordBatch]:
        for (lang, first), block in sums.items():
            a, b = np.nonzero(np.arange(block.shape[1])[None, :] > np.arange(first, first + len(block))[:, None])
            source = pa.array(names[lang], pa.string())
            rows = pa.table([pa.array(["pair"] * len(a), pa.string()), pa.array([lang] * len(a), pa.string()), source.take(pa.array(a + first)), source.take(pa.array(b)), pa.array(block[a, b])], schema=_FOUND)
            yield from rows.to_batches(1 << 16)
        sums.clear()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            first = own.slice(0, 1).to_pylist()[0]
            names[lang], total, all_total = first["all_sources"], np.array(first["totals"], np.int64), np.int64(first["lang_total"])
            source, width = pa.array(names[lang], pa.string()), len(first["totals"])
            listed = own["sources"].combine_chunks()
            at = pc.index_in(listed.flatten(), value_set=source).to_numpy()
            term = pc.list_parent_indices(listed).to_numpy()
            count = np.zeros((width, len(own)), np.int64)
            count[at, term] = own["counts"].combine_chunks().flatten().to_numpy()
            p, q = shares(count, total[:, None]), shares(count.sum(0), all_total)
            s, t = np.nonzero((count > 0) & (p > q))
            yield from pa.table([pa.array(["term"] * len(s), pa.string()), pa.array([lang] * len(s), pa.string()), source.take(pa.array(s)), own["term"].combine_chunks().take(pa.array(t)), pa.array(p[s, t] - q[t])], schema=_FOUND).to_batches(1 << 16)
            for block in range(0, width, SOURCE_BLOCK):
                if (lang, block) not in sums:
                    sums[lang, block] = np.zeros((min(SOURCE_BLOCK, width - block), width), np.int64)
                for i, line in enumerate(p[block : block + SOURCE_BLOCK]):
                    sums[lang, block][i] += np.abs(p - line).sum(1)
                if sum(x.size for x in sums.values()) > HELD_CELLS:
                    yield from pairs()
    yield from pairs()


def term_shards(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Stored rows ``(lang, term, sources, counts)``: one for each kept term, one with ``NO_TERM`` that lists a language's sources."""
    bounded_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    partial = read.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return materialize(dealt.mapInArrow(_shards(min_docs), "lang string, term string, sources array<string>, counts array<long>"), "divergence-shards")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = rows.withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def _total(n: Column, kept: Column) -> Column:
    return F.coalesce(n, F.lit(0)) + PRIOR * F.coalesce(kept, F.lit(0))


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source's terms are from its language's others.

    Part ``pair`` has each other source of the language, with the sum over all
    kept terms of the differences of their shares; part ``term`` the terms that a
    source has more of than its language, with the excess, the ``top_terms``
    largest.  Equal values rank by item.  Null languages, sources and texts are
    empty ones; repeated rows count as often as they occur; a group without terms
    has pairs like any other; a language without kept terms has pairs of value 0.
    Texts of any length are read whole.  Extra columns are not read.  An empty
    table gives an empty result.
    """
    shards = term_shards(docs, min_docs, text_col, lang_col, source_col)
    terms = shards.where(F.col("term") != NO_TERM)
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    sizes = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    present = shards.where(F.col("term") == NO_TERM).select("lang", F.explode("sources").alias("source"))
    groups = present.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), _total(F.col("n"), F.col("kept")).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "divergence-groups")
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"), (F.sum("n") + PRIOR * F.max("kept")).alias("lang_total"))
    by_lang = by_lang.select("lang", F.col("g.source").alias("all_sources"), F.col("g.total").alias("totals"), "lang_total")
    found = terms.join(broadcast_if_fits(by_lang), "lang").mapInArrow(_divergences, "part string, lang string, source string, item string, value long")
    found = materialize(found, "divergence-found")
    sums = found.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    apart = apart.select("a.lang", "a.source", F.col("b.source").alias("item")).join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = apart.select("lang", "value", F.explode(ends).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    high = found.where(F.col("part") == "term").select("lang", "source", "part", "item", "value")
    return _ranked(both).unionByName(_ranked(high, top_terms))
