"""Divergence of sources' term shares, and the terms that set a source apart from its language (op 13).

Terms are counted by block in Arrow batches and summed by Spark; all later steps are joins and sums
over the sparse counts. A pair of sources differs from the value of two sources without any term
only where one of them has the term: to the baseline of all V kept terms come corrections for the
terms of each alone, summed over equal shares first, and for the terms of both. The top terms of
each group come from a radix select: histograms over the value's bits, highest first, find the
value of rank k; a tie at that value narrows by the bytes of the terms. No group is sorted whole.
Integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import BROADCAST_ROWS, written
from lumenframe.llm.wordhash import blocks, column, raw

SCALE = 1_000_000_000  # shares are parts of it
LEAST_DOCS = 10
TOP = 10
VALUE_BITS, DIGIT_BITS = 30, 10  # a value is at most the larger share, below 2**30
TIE_BYTES = 2
TIES = 1000  # tied rows of one group that the last sort may hold
BLOCK = 1 << 21
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GROUP = ["lang", "source"]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a block of texts in text order, and the row of each."""
    data, offsets = raw(texts)
    solid = ~BREAKS[data]
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | start[1:n]
    first = np.flatnonzero(begin)
    place = np.cumsum(solid)
    at = np.concatenate([place[first] - 1, [place[-1] if n else 0]]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(LOWER[data[solid]]))
    return found, np.searchsorted(offsets, first, "right") - 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: lang, source, term, its occurrences and the rows that hold it; a null term stands for each group itself."""
    groups: dict[tuple[str, str], int] = {}
    for batch in blocks(batches, limit=BLOCK):
        of_row = np.array([groups.setdefault(k, len(groups)) for k in zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), strict=True)], np.int64)
        found, row = terms_of(column(batch, "text"))
        coded = found.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        in_row, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
        key, at = np.unique(of_row[in_row // size] * size + in_row % size, return_inverse=True)
        tf = np.bincount(at, n, len(key)).astype(np.int64)
        here = np.unique(of_row)
        names = list(groups)
        group = np.concatenate([key // size, here])
        term = pa.concat_arrays([coded.dictionary.take(pa.array(key % size)), pa.nulls(len(here), pa.large_string())]).cast(pa.string())
        pad = np.zeros(len(here), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[g][i] for g in group.tolist()], pa.string()) for i in (0, 1)]
            + [term, pa.array(np.concatenate([tf, pad])), pa.array(np.concatenate([np.bincount(at, minlength=len(key)), pad]))],
            ["lang", "source", "term", "n", "docs"],
        )


def whole(a: Column, b: Column) -> Column:
    """Floor of a quotient that is not negative."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    return F.lit(1) + whole((n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)"), (total + 2 * kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), p + q)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, broadcast up to BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def threshold(counts: DataFrame, digit: Column, keys: list[str]) -> DataFrame:
    """Of the digits of each group, in the order of ``digit``, the one at which ``need`` rows are reached (the last one if they never are), what is then still needed of it, and its rows."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    reached = counts.withColumn("upto", upto).withColumn("total", total)
    hit = (F.col("upto") >= F.least("need", "total")) & (F.col("upto") - F.col("n") < F.least("need", "total"))
    return reached.where(hit).select(*keys, "digit", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("tied"))


def top_rows(rows: DataFrame, k: int = TOP, ties: int = TIES) -> DataFrame:
    """The k rows of greatest ``value`` of each lang and source, ties to the term of smaller UTF-8 bytes, with ``rank`` from 1.

    rows: lang, source, term, value (0 to below 2**VALUE_BITS), no term twice in a group; a stored table.
    """
    state, n_groups = None, 0
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        left = rows if state is None else rows.join(small(state, n_groups), GROUP).where(F.shiftright("value", shift + DIGIT_BITS) == F.col("prefix"))
        digit = F.shiftright("value", shift).alias("digit")
        counts = left.groupBy(*GROUP, digit).agg(F.count("*").alias("n"), *([] if state is None else [F.first("need").alias("need")]))
        state = threshold(counts if state is not None else counts.withColumn("need", F.lit(k).cast("long")), F.col("digit").desc(), GROUP)
        state = written(state.withColumnRenamed("digit", "prefix"), "value-digits")
        n_groups = n_groups or state.count()
    cut = state.select(*GROUP, F.col("prefix").alias("least"), "need", "tied")
    at_cut = rows.join(small(cut, n_groups), GROUP)
    chosen = at_cut.where("value > least").select(*GROUP, "term", "value")
    few = F.col("tied") <= F.greatest("need", F.lit(ties))
    chosen = chosen.unionByName(at_cut.where("value = least").where(few).select(*GROUP, "term", "value"))
    open_ = cut.where(~few).select(*GROUP, "least", "need", F.lit(b"").alias("start"))
    place = 0
    while not open_.isEmpty():
        tied = rows.join(open_, GROUP).where("value = least").withColumn("bytes", F.col("term").cast("binary"))
        tied = tied.where(F.substring("bytes", 1, place) == F.col("start")).withColumn("digit", F.substring("bytes", place + 1, TIE_BYTES))
        counts = tied.groupBy(*GROUP, "digit").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("start").alias("start"), F.first("least").alias("least"))
        cuts = threshold(counts, F.col("digit").asc(), GROUP).join(counts.select(*GROUP, "digit", "start", "least"), [*GROUP, "digit"])
        cuts = written(cuts, "term-bytes")
        met = tied.drop("need").join(cuts.select(*GROUP, F.col("digit").alias("cut"), "need", F.col("tied").alias("same")), GROUP)
        done = F.col("same") <= F.greatest("need", F.lit(ties))
        take = (F.col("digit") < F.col("cut")) | (F.col("digit") == F.col("cut")) & done
        chosen = chosen.unionByName(written(met.where(take).select(*GROUP, "term", "value"), "tied-terms"))
        rest = cuts.where(F.col("tied") > F.greatest("need", F.lit(ties)))
        open_ = written(rest.select(*GROUP, "least", "need", F.concat("start", "digit").alias("start")), "open-ties")
        place += TIE_BYTES
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("term").asc()))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= k)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Divergence of each (lang, source) of ``docs(text, lang, source, ...)``: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and of all other characters from U+0080, A-Z lower-cased; a lang keeps those in at
    least ``least_docs`` of its rows. Part ``pair``: item is another source of the lang, value the
    sum of gap(p, q) over all kept terms. Part ``term``: item is a kept term whose share p is over
    the lang's share q, value gap(p, q), the ``top`` greatest. Null text, lang and source count as
    empty; repeated rows count as often as they occur; groups without terms have their pairs (value
    0 if the lang keeps none); a lang of one source has no pairs; other columns are ignored; an
    empty table gives no rows.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = written(parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    in_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(counts.where("term is not null").select(*GROUP, "term", "n").join(in_lang, ["lang", "term"]), "kept-terms")
    sizes = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select(*GROUP).join(totals, GROUP, "left").join(sizes, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    base = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    groups = written(groups.withColumn("base", base), "groups")
    n_groups = groups.count()
    groups = small(groups, n_groups)

    shares = kept.join(groups, GROUP)
    shares = shares.select(*GROUP, "term", "base", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    shares = written(shares, "shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    alike = shares.groupBy(*GROUP, "p").agg(F.count("*").alias("terms"), F.first("base").alias("base"))
    alone = alike.join(other, "lang").where("source != item")
    alone = alone.groupBy(*GROUP, "item").agg(F.sum(F.col("terms") * (gap(F.col("p"), F.col("other_base")) - gap(F.col("base"), F.col("other_base")))).alias("more"))
    a = shares.select("lang", "term", "source", "p", "base")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("base").alias("base2"))
    both = a.join(b, ["lang", "term"]).where("source < item")
    more = gap(F.col("p"), F.col("p2")) - gap(F.col("p"), F.col("base2")) - gap(F.col("base"), F.col("p2")) + gap(F.col("base"), F.col("base2"))
    both = both.groupBy(*GROUP, "item").agg(F.sum(more).alias("more"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more")
    plain = groups.join(other, "lang").where("source != item")
    plain = plain.select(*GROUP, "item", F.when(F.col("kept") > 0, F.col("kept") * gap(F.col("base"), F.col("other_base"))).otherwise(0).alias("more"))
    pairs = plain.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both)).groupBy(*GROUP, "item").agg(F.sum("more").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc()))
    pairs = pairs.withColumn("rank", rank).select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank")

    over = written(shares.where("p > q").select(*GROUP, "term", gap(F.col("p"), F.col("q")).alias("value")), "terms-over")
    terms = top_rows(over, top).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


#: The same by plain sums over all kept terms and sources.
SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
 v AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS total FROM k GROUP BY ALL),
 s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
 p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + {SCALE}::HUGEINT*(coalesce(n, 0)+2) // (coalesce(s.total, 0)+2*v) AS p, 1 + {SCALE}::HUGEINT*(in_lang+2) // (v.total+2*v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
 pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p) // (a.p+b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 term AS (SELECT lang, source, term AS item, ((p-q)*(p-q) // (p+q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
 SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
