"""Reading and writing the two catalog tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schema
from marketlens.session import shuffles_removed

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


#: Files whose headers are read at a time.
READERS = 16


def csv_by_headers(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a path as one table of text columns, each file by its own header.

    Files that share a header are one reader, so a folder of equal files is read as one table; others are
    united by column name, with nulls where a file lacks a column. Only the head of each file is read for this.
    """
    files = sorted(unquote(name) for name in spark.read.text(path).inputFiles())
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def header(file: str) -> tuple[str, ...]:
        return tuple(spark.read.options(**CSV).csv(file).columns)

    with ThreadPoolExecutor(READERS) as pool:
        # One job a different head, not a file: the driver keeps what each job sent out.
        heads = [head or file for file, head in zip(files, pool.map(lambda file: plain_head(spark, conf, file), files))]
        first = dict(zip(reversed(heads), reversed(files)))
        columns_of = dict(zip(first, pool.map(header, first.values())))
    headers = [columns_of[head] for head in heads]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, columns in zip(files, headers):
        if columns:
            by_header.setdefault(columns, []).append(file)
    if not by_header:
        raise ValueError(f"no CSV file with a header: {path}")
    # The declared names are the files' own, in their order: applying them by position is right here.
    frames = [spark.read.options(**CSV).schema(text_schema(columns)).csv(group) for columns, group in by_header.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def plain_head(spark: SparkSession, conf, file: str) -> str | None:
    """The first line of a plain or gzip file where equal lines are equal headers: not empty, and without quotes (which
    may hold line breaks) or lone carriage returns."""
    hadoop = spark._jvm.org.apache.hadoop
    path = hadoop.fs.Path(file)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    if codec is not None and codec.getDefaultExtension() != ".gz":
        return None
    stream = path.getFileSystem(conf).open(path)
    try:
        line = hadoop.io.Text()
        hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream, b"\n").readLine(line)
        head = line.toString()
    finally:
        stream.close()
    return head if head.strip() and '"' not in head and "\r" not in head[:-1] else None


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def read_catalog_csv(spark: SparkSession, products: str, reviews: str) -> tuple[DataFrame, DataFrame]:
    """Headered UTF-8 CSV whose cells may hold quotes and line breaks. Give directories of many files:

    a multi-line file is read by one task, so the number of files sets the parallelism. Columns may come in
    any order, another one in each file; unknown ones are left out, products get nulls for absent ones, reviews
    keep those they have.
    """
    found_products, found_reviews = csv_by_headers(spark, products), csv_by_headers(spark, reviews)
    schema.require_columns(found_products, schema.REQUIRED_PRODUCT_COLUMNS, "products")
    if not any(name in found_reviews.columns for name in schema.DATE_COLUMNS):
        raise ValueError(f"reviews lacks a date column, one of: {', '.join(schema.DATE_COLUMNS)}")
    everything = [F.col(f.name) if f.name in found_products.columns else F.lit(None).cast("string").alias(f.name) for f in schema.PRODUCTS]
    known = {f.name for f in schema.REVIEWS} | {*schema.DATE_COLUMNS, *schema.TEXT_COLUMNS}
    return found_products.select(*everything), found_reviews.select(*[c for c in found_reviews.columns if c in known])


def write_catalog_csv(df: DataFrame, path: str, compression: str = "none", mode: str = "overwrite") -> None:
    """One headered CSV file a task. Compressed files (``gzip``) take the fastest level: most of the disk for little time.

    The write's own shuffle files are removed when it ends, so they are not kept beside the next table's.
    """
    options = {"compression": compression, "zlib.compress.level": "BEST_SPEED", "header": "true"}
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).options(**options, escape='"', quoteAll="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", emptyValue='""').csv(path)


def bounds_query(table: str, key: str, parts: int) -> str:
    """The query that measures where a key's quantiles lie; the database runs it and returns one row a part."""
    ranked = f"select {key} as k, ntile({parts}) over (order by {key}) as part from {table} where {key} is not null"
    return f"(select part, min(k) as lower_bound from ({ranked}) ranked group by part) bounds"


def sql_literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def key_predicates(key: str, lower_bounds: list) -> list[str]:
    """Conditions that deal every row to one part: below the second bound, from each bound to the next, from the last on.

    Rows without a key are in the first part. Equal bounds (one key in several quantiles) make one part.
    """
    cuts = [sql_literal(v) for v in sorted(set(lower_bounds))[1:]]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} and {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} or {key} is null", *inner, f"{key} >= {cuts[-1]}"]


def read_table_in_parts(spark: SparkSession, url: str, table: str, key: str, partitions: int, **options) -> DataFrame:
    """A database table read in parallel between measured quantiles of a key, so that gaps and dense ranges of ids do not matter."""
    properties = {"fetchsize": "10000", **options}
    found = spark.read.jdbc(url, bounds_query(table, key, partitions), properties=properties)
    # One row a part.
    bounds = [row.lower_bound for row in found.collect()]
    return spark.read.jdbc(url, table, predicates=key_predicates(key, bounds), properties=properties)


def read_catalog_jdbc(
    spark: SparkSession,
    url: str,
    schema_name: str,
    products_table: str = "products",
    reviews_table: str = "reviews",
    products_key: str = "id",
    reviews_key: str = "review_id",
    partitions: int = 64,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The same tables from a database; filters and columns are pushed down. Reviews are split by their own id: by
    product, one product with a third of them would be one part."""
    products = read_table_in_parts(spark, url, f"{schema_name}.{products_table}", products_key, partitions, **options)
    return products, read_table_in_parts(spark, url, f"{schema_name}.{reviews_table}", reviews_key, partitions, **options)
