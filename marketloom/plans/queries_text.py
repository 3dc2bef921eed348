"""Documents, chunks, embeddings, retrieval and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages, requests, search, text, vectors
from ..sources import tables
from . import roles
from .registry import Tables, query


def _features(t: Tables) -> DataFrame:
    words = F.array(F.col("p_type"), *[F.get(F.split("p_name", " "), F.lit(i)) for i in (0, 1)])
    return t.part.select(F.col("p_partkey").alias("key"), F.explode(words).alias("name"))


def _reviews(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25).cast("string")).alias("brand_key"),
        F.when(F.col("lang") != "en", F.col("source")).alias("title"), "text", "n_chars", "doc_id",
    )


_REVIEWS = """rv AS (SELECT 'Brand#' || (doc_id % 25) AS brand_key, trim(concat_ws(' ', CASE WHEN lang <> 'en' THEN source END, nullif(text, ''))) AS t,
  row_number() OVER (PARTITION BY doc_id % 25 ORDER BY n_chars DESC, doc_id) AS n FROM documents),
sn AS (SELECT brand_key, string_agg(t, ' ' ORDER BY n) FILTER (t <> '') AS joined FROM rv WHERE n <= 10 GROUP BY 1),
sn2 AS (SELECT brand_key, CASE WHEN length(joined) > 600 THEN regexp_replace(left(joined, 600), ' [^ ]*$', '') ELSE joined END AS said FROM sn),
fe AS (SELECT item, 'Features: ' || list_aggregate(list_sort([drivetrain, fuel, transmission]), 'string_agg', ', ') || '.' AS f FROM items)"""


@query(f"""
WITH {roles.ITEMS}, {_REVIEWS}
SELECT item, concat_ws(' ', title, 'Brand: ' || brand || '.', 'Price: $' || format('{{:,}}', CAST(round_even(price, 0) AS BIGINT)) || '.',
  'Mileage: ' || format('{{:,}}', mileage) || ' miles.', 'Transmission: ' || transmission || '.', 'Drivetrain: ' || drivetrain || '.',
  'Owner rating: ' || CAST(rating AS VARCHAR) || '/5.', f, CASE WHEN said IS NOT NULL THEN 'What owners say: ' || said || '.' END) AS document
FROM items JOIN fe USING (item) LEFT JOIN sn2 ON brand = brand_key""")
def item_documents(t: Tables) -> DataFrame:
    snippets = text.review_snippets(
        _reviews(t), "brand_key", "title", "text", [F.col("n_chars").desc_nulls_last(), F.col("doc_id")]
    )
    items = roles.items(t).select(
        "item", "title", "brand", "price", "mileage", "transmission", "drivetrain", F.col("rating").alias("car_rating")
    )
    docs = text.item_documents(items, text.item_features(_features(t), "key", "name"), snippets, "item", "brand")
    return docs.select("item", "document")


@query(f"""
WITH {roles.ITEMS}
SELECT item, 'status: . title: ' || title || '. brand: ' || brand || '. interior_color: . exterior_color: . drivetrain: ' || drivetrain || '. fuel_type: ' || fuel
  || '. transmission: ' || transmission || '. engine: . features: {{"' || drivetrain || '":["' || fuel || '"]}}' AS document, item AS vin, price, brand AS brand_name
FROM items""")
def retrieval_documents(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    cols = {name: none for name in text.RETRIEVAL_FIELDS} | {
        "title": F.col("title"), "brand": F.col("brand"), "drivetrain": F.col("drivetrain"), "fuel_type": F.col("fuel"),
        "transmission": F.col("transmission"), "vin": F.col("item"), "price": F.col("price"),
    }
    features = F.create_map(F.col("drivetrain"), F.array("fuel"))
    docs = roles.items(t).select(
        "item", text.retrieval_document(cols, features).alias("document"), text.retrieval_metadata(cols).alias("m")
    )
    return docs.select("item", "document", F.col("m.VIN").alias("vin"), F.col("m.Price").alias("price"), F.col("m.Brand").alias("brand_name"))


@query("""
WITH d AS (SELECT doc_id, text, CAST(greatest(0, ceil((length(text) - 30) / 220.0) - 1) AS BIGINT) AS last FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS chunk_no FROM d)
SELECT doc_id, chunk_no, substr(text, chunk_no * 220 + 1, 250) AS chunk FROM c""")
def fixed_chunks(t: Tables) -> DataFrame:
    chunks = text.fixed_chunks(t.documents, "doc_id", "text", 250, 30)
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query()
def word_chunks(t: Tables) -> DataFrame:
    chunks = text.word_chunks(t.documents, "doc_id", "text", 250, 30)
    return chunks.withColumn("chunk_id", text.chunk_id(F.col("doc_id"), F.col("chunk_no")))


@query(f"""
WITH {roles.ITEMS} SELECT item AS vehicle_id, brand, title, price, CAST(mileage AS INTEGER) AS mileage FROM items""")
def vector_payloads(t: Tables) -> DataFrame:
    named = roles.items(t).select(F.col("item").alias("vehicle_id"), "brand", "title", "price", F.col("mileage").cast("int").alias("mileage"))
    return named.select(text.payload(named).alias("p")).select("p.*")


@query(f"""
WITH {roles.ITEMS} SELECT item FROM items WHERE crawled_at >= TIMESTAMP '2024-01-10' ORDER BY crawled_at DESC, item LIMIT 100""")
def updated_items(t: Tables) -> DataFrame:
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return text.updated_since(roles.items(t), "crawled_at", since, limit=100, tie="item").select("item")


@query()
def document_embeddings(t: Tables) -> DataFrame:
    made = text.hashed_tfidf(t.documents.select("doc_id", "text"), "text", dims=64)
    return made.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


@query("""
SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words FROM documents""")
def embedded_by_function(t: Tables) -> DataFrame:
    def two_numbers(batch: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(len(x.split(" ")))] for x in batch]

    made = text.embed(t.documents.select("doc_id", "text"), "text", two_numbers, batch_size=100)
    return made.select(
        "doc_id", F.get("embedding", F.lit(0)).cast("bigint").alias("chars"), F.get("embedding", F.lit(1)).cast("bigint").alias("words")
    )


@query("""
SELECT vec_id, CASE WHEN label < 5 THEN 'new' ELSE 'old' END AS version FROM embeddings""")
def upserted_points(t: Tables) -> DataFrame:
    points = t.embeddings.withColumn("point_id", text.point_id(F.col("vec_id")))
    old = points.select("point_id", "vec_id", F.lit("old").alias("version"))
    new = points.filter(F.col("label") < 5).select("point_id", "vec_id", F.lit("new").alias("version"))
    return tables.replace_by_key(old, new, ["point_id"]).select("vec_id", "version")


_NEAREST = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings),
hits AS (SELECT q.vec_id AS query, c.vec_id AS id, round(list_dot_product(q.v, c.v) / (q.len * c.len), 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v) / (q.len * c.len), 9) DESC, c.vec_id) AS rank
  FROM vec q JOIN vec c ON q.label = 0 AND c.label <> 0 QUALIFY rank <= 5)"""


def _retrieved(t: Tables) -> DataFrame:
    asked, corpus = t.embeddings.filter("label = 0"), t.embeddings.filter("label <> 0")
    return vectors.nearest_neighbors(asked, corpus, 5, "vec_id", "embedding", "vec_id", "embedding")


@query(f"""WITH {_NEAREST} SELECT query, id, round(score, 6) AS score, rank FROM hits""")
def retrieved_chunks(t: Tables) -> DataFrame:
    return _retrieved(t).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


@query(f"""
WITH {roles.ITEMS}, {_NEAREST},
asked AS (SELECT vec_id AS query, vec_id % 3 AS kind, 930 + 20 * (vec_id % 3) AS price_max, 'Brand#' || (1 + vec_id % 3) AS unwanted FROM embeddings WHERE label = 0),
f AS (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY price ASC NULLS LAST, item) AS n
  FROM (SELECT DISTINCT kind, price_max, unwanted FROM asked) JOIN items ON brand <> unwanted AND price <= price_max QUALIFY n <= 6)
SELECT query, item AS key, 'filter' AS source, NULL::DOUBLE AS score FROM asked JOIN f USING (kind)
UNION ALL SELECT query, item, 'semantic', round(score, 6) FROM hits JOIN asked USING (query) JOIN items ON id = item WHERE lower(brand) <> lower(unwanted)""")
def hybrid_retrieval(t: Tables) -> DataFrame:
    """Every query has a price limit and an unwanted brand of its own, one vector search and one constraint search answer them all."""
    items = roles.items(t)
    columns = search.Columns(key="item", status="transmission", fuel="fuel")
    kind = F.col("vec_id") % 3
    asked = t.embeddings.filter("label = 0").select(
        F.col("vec_id").alias("query"), (930 + 20 * kind).alias("price_max"), F.array(F.concat(F.lit("Brand#"), 1 + kind)).alias("exclude_brands")
    )
    rows = requests.answer_requests(items, columns, asked, "query", limit=6)
    hits = _retrieved(t).join(items, F.col("id") == F.col("item"))
    hits = search.exclude_asked(hits, "brand", asked.select("query", "exclude_brands"), "query", "exclude_brands")
    return text.hybrid_hits(rows, "item", hits.withColumn("score", F.round("score", 6)), "item", "score", "query")


_ASKED = """asked AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#' || (c_custkey % 27) END AS brand,
  CASE c_custkey % 4 WHEN 0 THEN 'BOLT' WHEN 1 THEN 'in' WHEN 2 THEN '' END AS model,
  CASE WHEN c_custkey % 5 > 0 THEN 850.0::DOUBLE + c_custkey % 1000 END AS price_min, CASE WHEN c_custkey % 7 > 0 THEN 950.0::DOUBLE + c_custkey % 1100 END AS price_max,
  CASE WHEN c_custkey % 6 = 1 THEN c_mktsegment[1:1] END AS fuel_type,
  CASE WHEN c_custkey % 2 = 0 THEN ['Brand#' || (c_nationkey + 1), 'Brand#7'] ELSE [] END AS exclude_brands FROM customer)"""


@query(f"""
WITH {roles.ITEMS}, {_ASKED},
m AS (SELECT query, item, price, row_number() OVER (PARTITION BY query ORDER BY price ASC NULLS LAST, item) AS position FROM asked a JOIN items i
  ON (a.brand IS NULL OR i.brand = a.brand) AND (a.model IS NULL OR contains(lower(title), lower(a.model))) AND (price_min IS NULL OR price >= price_min)
  AND (price_max IS NULL OR price <= price_max) AND (fuel_type IS NULL OR contains(lower(fuel), lower(fuel_type))) AND (len(exclude_brands) = 0 OR NOT list_contains(exclude_brands, i.brand)))
SELECT query, position, item, price FROM m WHERE position <= 6""")
def constraint_requests(t: Tables) -> DataFrame:
    """A request per customer, with limits, texts, brands and exclusions that differ from request to request."""
    n = F.col("c_custkey")
    asked = t.customer.select(
        n.alias("query"), F.when(n % 3 == 0, F.concat(F.lit("Brand#"), n % 27)).alias("brand"),
        F.when(n % 4 == 0, "BOLT").when(n % 4 == 1, "in").when(n % 4 == 2, "").alias("model"),
        F.when(n % 5 > 0, 850 + n % 1000).alias("price_min"), F.when(n % 7 > 0, 950 + n % 1100).alias("price_max"),
        F.when(n % 6 == 1, F.left("c_mktsegment", F.lit(1))).alias("fuel_type"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("Brand#"), F.col("c_nationkey") + 1), F.lit("Brand#7"))).otherwise(F.array().cast("array<string>")).alias("exclude_brands"),
    )
    columns = search.Columns(key="item", status="transmission", fuel="fuel")
    found = requests.answer_requests(roles.items(t), columns, asked, "query", limit=6)
    return found.select("query", F.col("position").cast("bigint").alias("position"), "item", "price")


# ---- pages ---------------------------------------------------------------------------


def _unescaped(x: str) -> str:
    return f"""replace(replace({x}, '&quot;', '"'), '&amp;', '&')"""


@query(f"""
SELECT page_id, trim({_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title, trim({_unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS heading,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<nav>.*?</nav>', 0, 's')) AS navs, len(regexp_extract_all(html, '<li>')) AS links,
  {_unescaped("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")} AS first_link
FROM pages""")
def page_fields(t: Tables) -> DataFrame:
    spec = {
        "titles": pages.Field("title"), "headings": pages.Field("article h1"), "langs": pages.Field("html", "lang"),
        "navs": pages.Field("nav"), "items": pages.Field("nav ul li"), "hrefs": pages.Field("nav a", "href"),
    }
    got = pages.extract_fields(t.pages, ["page_id"], "html", spec)
    return got.select(
        "page_id", pages.first("titles").alias("title"), pages.first("headings").alias("heading"), pages.first("langs").alias("lang"),
        F.size("navs").cast("bigint").alias("navs"), F.size("items").cast("bigint").alias("links"), pages.first("hrefs").alias("first_link"),
    )


_LINKS = """links AS (SELECT DISTINCT page_id, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h ELSE h END AS link
  FROM (SELECT page_id, url, replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '&amp;', '&') AS h FROM pages))"""


@query(f"""WITH {_LINKS} SELECT page_id, link FROM links WHERE contains(link, 'example.')""")
def page_links(t: Tables) -> DataFrame:
    return pages.page_links(t.pages, "page_id", F.col("url"), "html", keep="example.")


@query(f"""WITH {_LINKS} SELECT page_id, link FROM links WHERE link NOT IN (SELECT link FROM links JOIN pages USING (page_id) WHERE url LIKE 'https%')""")
def pending_links(t: Tables) -> DataFrame:
    links = pages.page_links(t.pages, "page_id", F.col("url"), "html")
    secure = t.pages.filter(F.col("url").startswith("https"))
    landed = pages.page_links(secure, "page_id", F.col("url"), "html").select(F.col("link").alias("done"))
    return pages.pending_links(links, landed, "link", "done")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'n' || c_custkey END AS used, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey END AS untitled,
  'm' || c_nationkey AS new, c_mktsegment AS monday, CAST(CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS days
FROM customer""")
def dealer_pages(t: Tables) -> DataFrame:
    """Pages with untitled phones and rows of one cell among the others."""
    key = F.col("c_custkey")
    html = F.concat(
        F.lit('<div class="dealer-phone">'), F.when(key % 3 != 0, '<span class="phone-number-title">Used</span>').otherwise(""),
        F.lit('<a class="phone-number">n'), key, F.lit('</a></div><div class="dealer-phone"><span class="phone-number-title">New</span><a class="phone-number">m'),
        F.col("c_nationkey"), F.lit('</a></div><table class="dealer-hours">'), F.when(key % 2 == 0, "<tr><td>Sales</td></tr>").otherwise(""),
        F.lit("<tr><td>Monday:</td><td>"), F.col("c_mktsegment"), F.lit("</td></tr>"), F.when(key % 5 == 0, "<tr><td>Sunday:</td><td></td></tr>").otherwise(""), F.lit("</table>"),
    )
    # Dealt before the pages are made: a narrow table of a few megabytes is one task, its pages are work for many.
    made = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").repartition("c_custkey").select(key.alias("id"), html.alias("html"))
    got = pages.dealer_records(pages.extract_fields(made, ["id"], "html", pages.DEALER_FIELDS), "id")
    return got.select(
        "id", F.col("phone_info.Used").alias("used"), F.col("phone_info.Unknown").alias("untitled"), F.col("phone_info.New").alias("new"),
        F.col("hours.Monday").alias("monday"), F.size("hours").cast("bigint").alias("days"),
    )


@query("""
SELECT p_partkey AS id, 'Used' AS condition, p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS price, 'V' || p_partkey AS vin,
  CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_type END AS safety, CASE WHEN p_size % 2 = 0 THEN 'w' || p_size END AS basic_warranty, 'w' || p_size AS drive_warranty,
  CAST(7 AS BIGINT) AS images
FROM part""")
def listing_pages(t: Tables) -> DataFrame:
    """Pages with equal headings, terms without a text of their own, and pictures without an address among the others."""
    block = lambda body: F.concat(F.lit('<div class="highlight-feature"><h3 class="features-spec-heading">Safety</h3><li data-qa="spec-value">'), body, F.lit("</li></div>"))
    html = F.concat(
        F.lit('<h1 id="vehicle-title">Used '), F.col("p_name"), F.lit('</h1><span class="list-price">$'), F.floor("p_retailprice"),
        F.lit('</span><section id="features-and-specs"><div class="subtitle">VIN: V'), F.col("p_partkey"), F.lit("</div></section>"),
        block(F.col("p_type")), F.when(F.col("p_size") % 4 == 0, block(F.col("p_brand"))).otherwise(""),
        F.lit('<section class="sds-page-section warranty_section"><dl class="fancy-description-list"><dt>Basic</dt>'),
        # Without a text of its own, a term has that of the next one in its list.
        F.when(F.col("p_size") % 2 == 0, "").otherwise('</dl><dl class="fancy-description-list">'), F.lit("<dt>Drive</dt><dd>w"), F.col("p_size"),
        F.lit('</dd></dl></section><fuse-gallery-grid id="gallery"><img>'), F.lit('<img src="a.jpg?w=1">' * 7), F.lit("</fuse-gallery-grid>"),
    )
    # Dealt before the pages are made, as for dealers.
    dealt = t.part.select("p_partkey", "p_name", "p_retailprice", "p_type", "p_brand", "p_size").repartition("p_partkey")
    got = pages.listing_records(pages.listing_fields(dealt.select(F.col("p_partkey").alias("id"), html.alias("html")), "id", "html"), "id", "https://site.example")
    return got.select(
        "id", F.col("post.new_used").alias("condition"), F.col("post.title").alias("title"), F.col("post.price").cast("bigint").alias("price"),
        F.col("post.basic_desc.VIN").alias("vin"), F.col("post.feature_des.Safety")[0].alias("safety"), F.col("post.warranty_des.Basic").alias("basic_warranty"),
        F.col("post.warranty_des.Drive").alias("drive_warranty"), F.size("post.image").cast("bigint").alias("images"),
    )


@query("""
SELECT doc_id AS id, CAST(1 + doc_id % 5 AS DOUBLE) AS rating, '5/' || (1 + doc_id % 28) || '/2023' AS time, lang AS author, source AS place,
  CASE WHEN doc_id % 3 <> 0 THEN source END AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source END AS body,
  CASE WHEN doc_id % 5 = 0 THEN 4.5 WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 4 AS DOUBLE) END AS comfort,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 7 AS DOUBLE) END AS value
FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def review_pages(t: Tables) -> DataFrame:
    """Pages of reviews, of which those without title and text are none.

    A breakdown of the old kind has a label twice, of which the last counts, one without a value, and one whose value is no number.
    """
    key = F.col("doc_id")
    name, value = '<li><span class="sds-definition-list__display-name">{}</span>', '<span class="sds-definition-list__value">'
    old = F.concat(
        F.lit('<ul class="review-breakdown--list">' + name.format("Comfort") + value + "1</span></li>" + name.format("Style") + "</li>" + name.format("Value") + value),
        key % 7, F.lit("</span></li>" + name.format("Comfort") + value), F.when(key % 4 == 3, "good").otherwise((key % 4).cast("string")), F.lit("</span></li></ul>"),
    )
    new = F.lit('<div class="ratings-breakdown"><fuse-stack><div class="review-text">Style</div></fuse-stack><fuse-stack><div class="review-text">Comfort <strong>4.5</strong></div></fuse-stack></div>')
    html = F.concat(
        F.lit('<div class="consumer-review-container"><fuse-rating rating="'), 1 + key % 5, F.lit('"></fuse-rating><div class="review-date">5/'), 1 + key % 28,
        F.lit('/2023</div><div class="author-details"><div>By '), F.col("lang"), F.lit(" from "), F.col("source"), F.lit("</div></div>"),
        F.when(key % 3 != 0, F.concat(F.lit('<h3 class="title">'), F.col("source"), F.lit("</h3>"))).otherwise(""),
        F.when(key % 2 == 0, F.concat(F.lit('<p class="review-body">'), F.col("lang"), F.lit(" "), F.col("source"), F.lit("</p>"))).otherwise(""),
        F.when(key % 5 == 0, new).otherwise(old), F.lit("</div>"),
    )
    got = pages.review_records(t.documents.select(key.alias("id"), html.alias("html")), "id", "html")
    return got.select(
        "id", F.col("review.overall_rating").alias("rating"), F.col("review.time").alias("time"), F.col("review.user_name").alias("author"),
        F.col("review.from").alias("place"), F.col("review.title").alias("title"), F.col("review.review").alias("body"),
        F.col("review.ratings_breakdown.Comfort").alias("comfort"), F.col("review.ratings_breakdown.Value").alias("value"),
    )
