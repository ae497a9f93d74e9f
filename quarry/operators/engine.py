"""All extractors over a crawl's pages in one run: functions of a page beside declared extractors, failures kept as rows, listed items once for a crawl."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions import text as tx

#: Claims that a site's menu repeats on every page: kept once for a crawl.
ONCE_PER_CRAWL = ["SERVICE_LISTED", "PRODUCT_LISTED"]
#: What a claim may hold besides the keys of its page; columns that an extractor doesn't give are null.
CLAIM_COLUMNS = {"claim_type": "string", "raw_value": "string", "normalized_value": "string", "evidence_text": "string", "evidence_locator": "string", "extraction_method": "string", "confidence": "double"}


def per_page(pages: DataFrame, keys: list[str], columns: list[str], function: Callable[..., Iterable[tuple]], result: str) -> DataFrame:
    """pages -> (keys, seq, the columns of `result`, error): the rows that function(*columns of a page) gives, or one row that tells its error.

    A page on which the function fails keeps none of its rows and costs no other page any. Pages pass by Arrow batches, each page by itself.
    """
    wanted = T._parse_datatype_string(result)
    schema = T.StructType([*[pages.schema[k] for k in keys], T.StructField("seq", T.IntegerType()), *wanted.fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)
    nothing = (None,) * len(wanted.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                try:
                    out += [(*key, i, *found, None) for i, found in enumerate(list(function(*(row[c] for c in columns))))]
                except Exception as e:
                    out.append((*key, None, *nothing, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return pages.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, schema)


def strings_of(texts: list[str] | None) -> Iterator[tuple[int, str, str]]:
    """(text, key in lower case, value) of every string under a key at any depth of JSON texts. Of what an object or list holds, the last is opened first. A text that is no JSON gives nothing."""
    for at, text in enumerate(texts or []):
        try:
            waiting = [json.loads(text)]
        except (ValueError, TypeError, RecursionError):
            continue
        while waiting:
            here = waiting.pop()
            if isinstance(here, list):
                waiting.extend(here)
            elif isinstance(here, dict):
                yield from ((at, key.lower(), value) for key, value in here.items() if isinstance(value, str))
                waiting.extend(value for value in here.values() if isinstance(value, dict | list))


def json_strings(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, text, key, value): the strings of a page's structured data at any depth, in the order in which they are met."""
    pages = parsed.select(*keys, F.col("page.json_ld").alias("json_ld"))
    return per_page(pages, keys, ["json_ld"], strings_of, "text int, key string, value string").where("error is null").drop("error")


def run_extractors(
    parsed: DataFrame,
    keys: list[str],
    crawl: str,
    declared: dict[str, Callable[[DataFrame, list[str]], DataFrame]],
    functions: dict[str, tuple[list[str], Callable[..., Iterable[tuple]]]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Runs extractors over the pages of crawls: (claims, errors).

    Each extractor reads parsed by itself, so parsed should be a stored or persisted table, as reading HTML is what costs most.
    parsed holds the keys of a page (the last of them tells the order of a crawl's pages), the column `crawl`, url and page. declared: extractors
    that map (parsed, keys) to claims with Spark expressions. functions: (columns, function of a page) whose results are tuples of CLAIM_COLUMNS.
    claims: a claim of each type and value of a page, the first by extractor, then by seq; those of ONCE_PER_CRAWL only on the crawl's first page
    that has them. errors (keys, extractor, error): pages on which a function failed, and, with null keys, extractors that can't be planned on
    these pages; what the others find stays.
    """
    all_keys = list(dict.fromkeys([crawl, *keys]))
    parts, failed, unplanned = [], [], []

    def as_claims(df: DataFrame, place: int, name: str) -> DataFrame:
        given = set(df.columns)
        columns = [(F.col(c) if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in CLAIM_COLUMNS.items()]
        seq = F.col("seq").cast("long") if "seq" in given else F.lit(0).cast("long")
        return df.select(*all_keys, *columns, F.lit(name).alias("extractor"), F.lit(place).alias("place"), seq.alias("seq"))

    for place, (name, extract) in enumerate(declared.items()):
        try:
            parts.append(as_claims(extract(parsed, all_keys), place, name))
        except PySparkException as e:
            unplanned.append((name, f"{type(e).__name__}: {e}"[:500]))
    for place, (name, (columns, function)) in enumerate((functions or {}).items(), len(declared)):
        rows = per_page(parsed, all_keys, columns, function, ", ".join(f"{c} {kind}" for c, kind in CLAIM_COLUMNS.items()))
        parts.append(as_claims(rows.where("error is null"), place, name))
        failed.append(rows.where("error is not null").select(*keys, F.lit(name).alias("extractor"), "error"))
    claims = parts[0]
    for more in parts[1:]:
        claims = claims.unionByName(more)
    listed = F.col("claim_type").isin(*ONCE_PER_CRAWL)
    value = F.lower(tx.strip(F.col("raw_value")))
    order = F.struct(*keys, "place", "seq")
    # A listed item's page is no part of its key, so the least order of the crawl wins; partial minima come before the shuffle.
    page = F.when(~listed, F.struct(*keys))
    first = claims.groupBy(F.col(crawl).alias("_crawl"), "claim_type", value.alias("_value"), page.alias("_page")).agg(F.min_by(F.struct(*claims.columns), order).alias("c"))
    spark = parsed.sparkSession
    nowhere = spark.createDataFrame(unplanned, "extractor string, error string").select(*[F.lit(None).cast(parsed.schema[k].dataType).alias(k) for k in keys], "extractor", "error")
    errors = nowhere
    for more in failed:
        errors = errors.unionByName(more)
    return first.select("c.*").drop("place"), errors
