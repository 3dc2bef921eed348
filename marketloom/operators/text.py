"""Item documents, chunks, payloads and embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import uuid5
from ..functions.scoring import grouped_number
from ..functions.text import labelled, sentence_list, truncate_at_word
from .latest import top_n_per_key

# Labelled attributes of an item document, in order.
DOCUMENT_LABELS = {
    "fuel_type": "Fuel", "transmission": "Transmission", "drivetrain": "Drivetrain", "engine": "Engine",
    "exterior_color": "Exterior color", "mpg": "MPG",
}
# Attributes of a retrieval document, in order.
RETRIEVAL_FIELDS = (
    "status", "title", "brand", "interior_color", "exterior_color", "drivetrain", "fuel_type", "transmission", "engine",
)
# Metadata name per column of a retrieval document.
RETRIEVAL_METADATA = {
    "VIN": "vin", "Price": "price", "Monthly Payment": "monthly_payment", "Mileage": "mileage",
    "Miles Per Gallon": "mpg", "Post Link": "vehicle_url", "Status": "status", "Title": "title", "Brand": "brand",
    "Interior Color": "interior_color", "Exterior Color": "exterior_color", "Drivetrain": "drivetrain",
    "Fuel Type": "fuel_type", "Transmission": "transmission", "Engine": "engine",
}
# Columns of a vector payload.
PAYLOAD_FIELDS = (
    "vehicle_id", "brand", "car_model", "car_name", "title", "new_used", "price", "mileage", "fuel_type",
    "car_rating", "primary_image_url",
)
# Default id namespace of vector points. Pass the namespace of an existing store to keep its ids.
POINT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "marketloom.points")
MAX_FEATURES = 30
MAX_REVIEW_CHARS = 600
REVIEWS_PER_MODEL = 10


def point_id(key: Column, namespace: uuid.UUID = POINT_NAMESPACE) -> Column:
    return uuid5(namespace, key)


def review_snippets(
    reviews: DataFrame, model: str, title: str, text: str, order: Sequence[Column], n: int = REVIEWS_PER_MODEL,
    max_chars: int = MAX_REVIEW_CHARS,
) -> DataFrame:
    """(model, said): the joined texts of the newest `n` reviews per model, cut at a word boundary by `max_chars`.

    Cut per model, before any item is joined, so that long texts are not copied to every item.
    """
    snippet = F.trim(F.concat_ws(" ", F.nullif(F.col(title), F.lit("")), F.nullif(F.col(text), F.lit(""))))
    some = reviews.filter(F.col(text).isNotNull() | F.col(title).isNotNull())
    top = top_n_per_key(some, [model], order, n, rank="_r").select(F.col(model).alias("_model"), "_r", snippet.alias("_t"))
    listed = top.filter(F.col("_t") != "").groupBy("_model").agg(F.array_sort(F.collect_list(F.struct("_r", "_t"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["_t"]), " ")
    return listed.select("_model", truncate_at_word(joined, max_chars).alias("said"))


def item_features(features: DataFrame, key: str, name: str, n: int = MAX_FEATURES) -> DataFrame:
    """(key, features): the first `n` feature names per item, sorted."""
    rows = features.filter(F.col(name) != "").select(F.col(key).alias("_item"), F.col(name).alias("_f"))
    rows = top_n_per_key(rows, ["_item"], [F.col("_f")], n)
    return rows.groupBy("_item").agg(F.array_sort(F.collect_list("_f")).alias("features"))


def document_text(has: Mapping[str, Column], max_features: int = MAX_FEATURES) -> Column:
    """Text of an item document; every missing or empty part is left out, features beyond `max_features` too.

    `has` maps the part names (see `item_documents`) to columns.
    """
    c = has

    def present(col: Column) -> Column:
        return col.isNotNull() & (col.cast("string") != "")

    head = F.trim(F.concat_ws(" ", F.nullif(c["new_used"], F.lit("")), F.nullif(c["title"], F.lit(""))))
    parts = [
        F.nullif(head, F.lit("")),
        labelled("Brand", c["brand"]),
        labelled("Model", c["car_name"]),
        F.when(c["price"] != 0, F.concat(F.lit("Price: "), grouped_number(c["price"], "$", "."))),
        F.when(c["mileage"] != 0, F.concat(F.lit("Mileage: "), grouped_number(c["mileage"], suffix=" miles."))),
        *[labelled(label, c[name]) for name, label in DOCUMENT_LABELS.items()],
        F.when(c["car_rating"] != 0, F.concat(F.lit("Owner rating: "), c["car_rating"].cast("string"), F.lit("/5."))),
        sentence_list("Features", c["features"], max_features),
        F.when(
            present(c["seller_name"]),
            F.concat(F.lit("Sold by "), c["seller_name"], F.lit(" ("), F.coalesce(c["destination"], F.lit("")), F.lit(").")),
        ),
        labelled("What owners say", c["said"]),
    ]
    return F.concat_ws(" ", *parts)


def item_documents(
    items: DataFrame, features: DataFrame, snippets: DataFrame, key: str, model: str, max_features: int = MAX_FEATURES
) -> DataFrame:
    """`items` with `features` and `document`; features and reviews are optional per item."""
    joined = items.join(features, F.col(key) == F.col("_item"), "left").drop("_item")
    joined = joined.join(snippets, F.col(model) == F.col("_model"), "left").drop("_model")
    names = ("new_used", "title", "brand", "car_name", "price", "mileage", *DOCUMENT_LABELS, "car_rating", "features",
             "seller_name", "destination")
    have = {n: F.col(n) if n in joined.columns else F.lit(None).cast("string") for n in names}
    return joined.withColumn("document", document_text({**have, "said": F.col("said")}, max_features)).drop("said")


def retrieval_document(cols: Mapping[str, Column], features: Column) -> Column:
    """'status: .. title: ..' text; `features` is a map column, shown as JSON."""
    parts = [
        F.concat(F.lit(f"{name}: "), F.coalesce(cols[name].cast("string"), F.lit(""))) for name in RETRIEVAL_FIELDS
    ]
    return F.concat_ws(". ", *parts, F.concat(F.lit("features: "), F.coalesce(F.to_json(features), F.lit("{}"))))


def retrieval_metadata(cols: Mapping[str, Column]) -> Column:
    return F.struct(*[cols[src].alias(name) for name, src in RETRIEVAL_METADATA.items() if src in cols])


def payload(df: DataFrame) -> Column:
    """Metadata struct stored with a vector."""
    return F.struct(*[F.col(c) for c in PAYLOAD_FIELDS if c in df.columns])


def updated_since(df: DataFrame, col: str, since: Column | None, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Items changed on or after a date, newest first, at most `limit`."""
    rows = df if since is None else df.filter(F.col(col) >= since)
    order = [F.col(col).desc_nulls_last()] + ([F.col(tie)] if tie else [])
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


# ---- chunks --------------------------------------------------------------------------


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 250, overlap: int = 30) -> DataFrame:
    """(key, chunk_no, chunk): windows of `size` characters that start every `size - overlap`.

    Windows stop once the end of the text is covered. A native expression over whole texts.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int")
    # Cut first, so that no row carries a whole text besides its piece.
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return df.filter(F.length(text) > 0).select(key, F.posexplode(pieces).alias("chunk_no", "chunk"))


#: Characters of texts that are cut before their chunks are handed on.
CHUNKED_AT_ONCE = 1 << 20

# Where texts are split, coarsest first.
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, size: int, separators: Sequence[str]) -> Iterator[str]:
    """Split at the coarsest separator that occurs; it stays at the start of the piece after it.

    Pieces that are still too long yield the pieces of the finer separators.
    """
    for level, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    finer = separators[level + 1 :]
    if sep:
        first, *rest = text.split(sep)
        parts = [first, *(sep + r for r in rest)]
    else:
        parts = list(text)
    run: list[str] = []
    for part in parts:
        if not part:
            continue
        if len(part) < size or not finer:
            run.append(part)
            continue
        if run:
            yield run
            run = []
        yield from _pieces(part, size, finer)
    if run:
        yield run


def split_text(text: str, size: int = 250, overlap: int = 30, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters; each repeats up to `overlap` characters of whole pieces before it.

    Only pieces of the same level are joined. Chunks are trimmed; empty ones are left out.
    """
    chunks: list[str] = []

    def emit(parts: Sequence[str]) -> None:
        chunk = "".join(parts).strip()
        if chunk:
            chunks.append(chunk)

    for run in _pieces(text, size, separators):
        window: list[str] = []
        length = 0
        for part in run:
            if window and length + len(part) > size:
                emit(window)
                # Keep a tail for the overlap, short enough that the next piece still fits.
                while window and (length > overlap or length + len(part) > size):
                    length -= len(window.pop(0))
            window.append(part)
            length += len(part)
        emit(window)
    return chunks


def word_chunks(df: DataFrame, key: str, text: str, size: int = 250, overlap: int = 30) -> DataFrame:
    """(key, chunk_no, chunk): chunks cut at paragraph, line and word boundaries."""
    key_type = df.schema[key].dataType.simpleString()

    # A batch is up to 10,000 rows, however long: the chunks of about `CHUNKED_AT_ONCE` characters are Python strings at a time.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            held, at, numbers, chunks = 0, [], [], []
            for i in range(b.num_rows):
                whole = texts[i].as_py()
                found = split_text(whole, size, overlap) if whole else []
                at.extend([i] * len(found))
                numbers.extend(range(len(found)))
                chunks.extend(found)
                held += len(whole or "")
                if held >= CHUNKED_AT_ONCE or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], [key, "chunk_no", "chunk"]
                    )
                    held, at, numbers, chunks = 0, [], [], []

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, chunk_no int, chunk string")


def chunk_id(key: Column, chunk_no: Column, namespace: uuid.UUID = POINT_NAMESPACE) -> Column:
    """Stable id of a chunk, so that chunks can be replaced without a full rebuild."""
    return uuid5(namespace, F.concat_ws("#", key.cast("string"), chunk_no.cast("string")))


# ---- embeddings ----------------------------------------------------------------------


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], Sequence[Sequence[float]]], batch_size: int = 100,
          out: str = "embedding") -> DataFrame:
    """Vectors from a caller's function, called with at most `batch_size` texts at a time in every task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list = []
            for start in range(0, len(b), batch_size):
                vectors.extend(fn(b[text].iloc[start : start + batch_size].tolist()))
            b[out] = vectors
            yield b

    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def hashed_tfidf(df: DataFrame, text: str, dims: int = 256, out: str = "embedding") -> DataFrame:
    """Offline embedding: hashed, idf-weighted, unit-length word counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    known = df.filter(F.col(text).isNotNull())
    made = Pipeline(stages=stages).fit(known).transform(known)
    return made.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def hybrid_hits(rows: DataFrame, row_key: str, semantic: DataFrame, semantic_key: str, score: str, query: str) -> DataFrame:
    """Hard-filter rows and semantic hits of each query side by side: (query, key, source, score)."""
    hard = rows.select(query, F.col(row_key).alias("key"), F.lit("filter").alias("source"), F.lit(None).cast("double").alias("score"))
    soft = semantic.select(query, F.col(semantic_key).alias("key"), F.lit("semantic").alias("source"), F.col(score).alias("score"))
    return hard.unionByName(soft)
