"""Highlights: where terms stand in documents, in bytes or UTF-16 units.

Texts in Latin script are searched in the JVM, run by run; the rest go through the analyzer, and
pinyin is derived only where some term doesn't stand in the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.analyzer import Analyzer, spans_by_start, to_utf16
from ..schema import PositionEncoding
from ..session import reachable


def _rows(batches: Iterator[pa.RecordBatch], analyzer: Analyzer, encoding: PositionEncoding) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for k, (content, terms) in enumerate(zip(batch.column("content").to_pylist(), batch.column("terms").to_pylist())):
            text = content or ""
            own = spans_by_start(analyzer.tokens(text, derive=False), terms or [], lambda text=text: analyzer.tokens(text))
            own = to_utf16(content or "", own) if encoding == PositionEncoding.UTF16 else own
            for n, (start, end) in enumerate(own):
                at.append(k)
                found.append((n, start, end))
        cols = list(zip(*found)) if found else [[]] * 3
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(take) for c in ("query_id", "index_name", "doc_id")], *[pa.array(c, pa.int32()) for c in cols]],
            names=["query_id", "index_name", "doc_id", "nth", "start", "end"],
        )


def native_spans(content: Column, terms: Column, encoding: PositionEncoding) -> Column:
    """Spans of terms in a native text, in order: as many of a run as it is listed among the terms.

    Native texts hold no character beyond the first plane, so UTF-16 units are characters."""
    size = F.octet_length if encoding == PositionEncoding.BYTES else F.length
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("found"))

    def step(seen: Column, run: Column) -> Column:
        end = seen["at"] + size(run)
        folded = T.fold(run)
        span = F.struct(seen["at"].alias("start"), end.alias("end"))
        more = F.concat(seen["found"], F.array_repeat(span, F.size(F.filter(terms, lambda t: t == folded))))
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, folded), more).otherwise(seen["found"]).alias("found"))

    return F.aggregate(F.regexp_extract_all(content, F.lit(r"[\p{IsLatin}0-9]+|[^\p{IsLatin}0-9]+"), F.lit(0)), start, step)["found"]


def _shown(rows: DataFrame, analyzer: Analyzer, encoding: PositionEncoding) -> DataFrame:
    """Spans of the terms of each row (query_id, index_name, doc_id, content, terms)."""
    reachable(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"query_id string, index_name string, doc_id {kind}, nth int, start int, end int"
    native = F.lit(False) if analyzer.tokenizers else F.coalesce(T.is_native(F.col("content")), F.lit(False))
    plain = rows.filter(native).select("query_id", "index_name", "doc_id", F.posexplode(native_spans(F.col("content"), F.col("terms"), encoding)).alias("nth", "span"))
    plain = plain.select("query_id", "index_name", "doc_id", "nth", "span.start", "span.end")
    return plain.unionByName(rows.filter(~native).mapInArrow(lambda b: _rows(b, analyzer, encoding), schema))


def highlight(documents: DataFrame, wanted: DataFrame, analyzer: Analyzer | None = None, encoding: PositionEncoding = PositionEncoding.UTF16) -> DataFrame:
    """Spans of (query_id, index_name, doc_id, terms) in the documents: (…, nth, start, end) by start.

    A term that stands in the text itself is shown there, another where it was derived from."""
    rows = documents.filter("indexed").join(wanted, ["index_name", "doc_id"]).select("query_id", "index_name", "doc_id", "content", "terms")
    return _shown(rows, analyzer or Analyzer(), PositionEncoding(encoding))


def highlight_everywhere(documents: DataFrame, terms: list[str], analyzer: Analyzer | None = None, encoding: PositionEncoding = PositionEncoding.UTF16, query_id: str = "q") -> DataFrame:
    """``highlight`` of the same terms in every document: texts are searched where they are read, and none is exchanged."""
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    rows = documents.filter("indexed").select(F.lit(query_id).alias("query_id"), "index_name", "doc_id", "content", wanted.alias("terms"))
    return _shown(rows, analyzer or Analyzer(), PositionEncoding(encoding))


def highlight_hits(documents: DataFrame, hits: DataFrame, analyzer: Analyzer | None = None, encoding: PositionEncoding = PositionEncoding.UTF16) -> DataFrame:
    """Spans of the matched terms of hits."""
    wanted = hits.select("query_id", "index_name", "doc_id", F.transform("matched_terms", lambda m: m["term"]).alias("terms"))
    return highlight(documents, wanted, analyzer, encoding)
