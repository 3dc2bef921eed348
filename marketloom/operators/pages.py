"""Raw pages to records: links, selected fields, and the listing document built from them.

One small parser pass per page picks texts and attributes by selector; everything after
that (numbers, labels, dates, nesting) is native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, patterns, urls

HREF = r'href="([^"]*)"'


# ---- links ---------------------------------------------------------------------------


def page_links(pages: DataFrame, key: str, url: Column, html: str, keep: str | None = None) -> DataFrame:
    """Distinct (key, link) of a page, absolute; `keep` is a text the link must contain."""
    hrefs = pages.select(key, url.alias("_base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("_h"))
    unescaped = F.replace(F.col("_h"), F.lit("&amp;"), F.lit("&"))
    links = hrefs.select(key, urls.absolutize(unescaped, F.col("_base")).alias("link")).filter(F.col("link").isNotNull())
    if keep:
        links = links.filter(F.col("link").contains(keep))
    return links.distinct()


def pending_links(links: DataFrame, landed: DataFrame, link: str, landed_link: str) -> DataFrame:
    """Links without a saved record."""
    done = landed.select(F.col(landed_link).alias("_done"))
    return links.join(done, F.col(link) == F.col("_done"), "left_anti")


# ---- fields --------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Text of the elements that match `selector`, the value of one of their attributes, or their names (`TAG`) or which alternative of the selector they match (`WHICH`)."""

    selector: str
    attr: str | None = None


TAG = ":tag"
WHICH = ":which"
_STEP = re.compile(r"^([a-z0-9\-]*)((?:[#.][\w\-]+)*)(?:\[([\w\-]+)(\*?)=([^\]]*)\])?$")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _compile(selector: str) -> list[list[tuple]]:
    """Alternatives of descendant steps (tag, id, classes, attribute, is_substring, value)."""
    chains = []
    for alternative in selector.split(","):
        chain = []
        for step in alternative.split():
            tag, marks, name, sub, value = _STEP.match(step).groups()
            found = re.findall(r"([#.])([\w\-]+)", marks)
            ids = [v for kind, v in found if kind == "#"]
            chain.append((tag, ids[0] if ids else None, {v for kind, v in found if kind == "."}, name, bool(sub), value))
        chains.append(chain)
    return chains


def _fits(step: tuple, element: tuple) -> bool:
    tag, id_, classes, name, substring, value = step
    own_tag, attrs, own_classes = element
    if (tag and tag != own_tag) or (id_ and attrs.get("id") != id_) or not classes <= own_classes:
        return False
    own = attrs.get(name) if name else None
    return name is None or (own is not None and (value in own if substring else value == own))


#: States and elements that a matcher remembers at most; beyond that it starts anew.
_REMEMBERED = 1 << 15


class _State:
    """What of an element and those around it matters: the steps that each fits, of those that fit any."""

    __slots__ = ("path", "next")

    def __init__(self, path: tuple[int, ...]):
        self.path, self.next = path, {}


class _Matcher:
    """Which fields the innermost element matches.

    Pages of one site repeat few elements in few places. So the steps of all selectors that an element fits are looked up by its
    tag and the attributes that selectors name, and the fields that it matches by the steps that it and those around it fit.
    """

    def __init__(self, fields: Mapping[str, tuple[list, str | None]]):
        steps: list[tuple] = []
        number = lambda step: steps.index(step) if step in steps else (steps.append(step), len(steps) - 1)[1]
        self.fields = [(name, attr, [[number(step) for step in chain] for chain in chains]) for name, (chains, attr) in fields.items()]
        self.steps = steps
        self.named = ["id", "class", *sorted({s[3] for s in steps if s[3]} - {"id", "class"})]
        self._forget()

    def _forget(self) -> None:
        self.root, self.states, self.elements = _State(()), 0, {}

    def start(self) -> _State:
        """The state outside of all elements, at the start of a page."""
        if self.states > _REMEMBERED:
            self._forget()
        return self.root

    def _fitting(self, tag: str, attrs: Mapping[str, str]) -> int:
        key = (tag, *map(attrs.get, self.named))
        found = self.elements.get(key)
        if found is None:
            element = (tag, attrs, set(attrs.get("class", "").split()))
            found = sum(1 << i for i, step in enumerate(self.steps) if _fits(step, element))
            if len(self.elements) < _REMEMBERED:
                self.elements[key] = found
        return found

    def enter(self, state: _State, tag: str, attrs: Mapping[str, str]) -> tuple[_State, list[tuple]]:
        """The state inside of an element and (name, attribute, alternative) of the fields that it matches."""
        fitting = self._fitting(tag, attrs)
        if not fitting:
            return state, []
        found = state.next.get(fitting)
        if found is None:
            inner = _State((*state.path, fitting))
            hits = [(name, attr, self._which(chains, inner.path)) for name, attr, chains in self.fields]
            found = state.next[fitting] = (inner, [hit for hit in hits if hit[2] is not None])
            self.states += 1
        return found

    @staticmethod
    def _which(chains: list[list[int]], path: tuple[int, ...]) -> int | None:
        """The first alternative that the innermost element matches."""
        for n, chain in enumerate(chains):
            if not path[-1] >> chain[-1] & 1:
                continue
            above = iter(reversed(path[:-1]))
            if all(any(e >> step & 1 for e in above) for step in reversed(chain[:-1])):
                return n
        return None


class _Picker(HTMLParser):
    """Collects the values of all fields in document order in one pass."""

    def __init__(self, matcher: _Matcher, names: list[str]):
        super().__init__(convert_charrefs=True)
        self.matcher, self.names, self.outside = matcher, names, matcher.start()
        self.found: dict[str, list[str]] = {name: [] for name in names}
        self.stack: list[tuple[str, _State]] = []
        self.open: list[tuple[int, str, int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        state, hits = self.matcher.enter(self.stack[-1][1] if self.stack else self.outside, tag, values)
        self.stack.append((tag, state))
        for name, attr, which in hits:
            self._take(name, attr, which, tag, values)
        if tag in _VOID:
            self._close(len(self.stack) - 1)

    def _take(self, name, attr, which, tag, values):
        if attr is None:
            # Reserve the place now, so that nested matches keep document order.
            self.found[name].append("")
            self.open.append((len(self.stack), name, len(self.found[name]) - 1, []))
        elif attr == TAG:
            self.found[name].append(tag)
        elif attr == WHICH:
            self.found[name].append(str(which))
        elif values.get(attr):
            self.found[name].append(values[attr])

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        if not self.open:
            return
        piece = data.strip()
        if piece and not (self.stack and self.stack[-1][0] in ("script", "style")):
            for _, _, _, pieces in self.open:
                pieces.append(piece)

    def _close(self, depth: int):
        if self.open and self.open[-1][0] > depth:
            for entry in [e for e in self.open if e[0] > depth]:
                _, name, place, pieces = entry
                self.found[name][place] = "".join(pieces)
                self.open.remove(entry)
        del self.stack[depth:]

    def done(self) -> dict[str, list[str]]:
        self.close()
        self._close(0)
        return self.found


#: Name under which a matcher finds the containers of records.
_BOX = ":box"


class _RecordPicker(_Picker):
    """Like `_Picker`, with a separate set of values for every container element."""

    def __init__(self, matcher: _Matcher, names: list[str]):
        super().__init__(matcher, names)
        self.records: list[dict[str, list[str]]] = []
        self.inside = 0

    def _take(self, name, attr, which, tag, values):
        if name != _BOX:
            super()._take(name, attr, which, tag, values)
        elif not self.inside:
            self.inside = len(self.stack)
            self.found = {n: [] for n in self.names}
            self.records.append(self.found)

    def _close(self, depth: int):
        super()._close(depth)
        if self.inside > depth:
            self.inside = 0
            self.found = {name: [] for name in self.names}


def _compiled(spec: Mapping[str, Field]) -> dict[str, tuple[list, str | None]]:
    return {name: (_compile(f.selector), f.attr) for name, f in spec.items()}


def _schema(pages: DataFrame, keep: list[str], spec: Mapping[str, Field]) -> str:
    kept = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return ", ".join([*kept, *(f"{name} array<string>" for name in spec)])


def extract_fields(pages: DataFrame, keep: list[str], html: str, spec: Mapping[str, Field]) -> DataFrame:
    """(keep..., <field> array<string> ...): every match of every field, in document order."""
    compiled, names = _compiled(spec), list(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _Matcher(compiled)
        for b in batches:
            rows = []
            for page in b[html]:
                picker = _Picker(matcher, names)
                picker.feed(page or "")
                rows.append(picker.done())
            yield b[keep].assign(**{name: [r[name] for r in rows] for name in spec})

    return pages.select(*keep, html).mapInPandas(run, _schema(pages, keep, spec))


def extract_records(pages: DataFrame, keep: list[str], html: str, container: str, spec: Mapping[str, Field]) -> DataFrame:
    """One row (keep..., <field> array<string> ...) per container element of a page."""
    # The container first, so that a record begins before the fields that its own element matches.
    compiled, names = {_BOX: (_compile(container), None), **_compiled(spec)}, list(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _Matcher(compiled)
        for b in batches:
            rows, at = [], []
            for i, page in enumerate(b[html]):
                picker = _RecordPicker(matcher, names)
                picker.feed(page or "")
                picker.done()
                rows.extend(picker.records)
                at.extend([i] * len(picker.records))
            if rows:
                yield b[keep].iloc[at].assign(**{name: [r[name] for r in rows] for name in spec})

    return pages.select(*keep, html).mapInPandas(run, _schema(pages, keep, spec))


def first(col: str) -> Column:
    """First match of a field, NULL when there is none or it is empty."""
    return F.nullif(F.get(F.col(col), F.lit(0)), F.lit(""))


# ---- the listing document ------------------------------------------------------------

# Where the fields of a detail page are. A block and what is in it, for fields that go together.
_WARRANTY = ", ".join(
    f"{dl}{part}" for dl in ("section.sds-page-section.warranty_section dl.fancy-description-list", "fuse-popover#cpo-popover dl") for part in ("", " dt", " dd")
)
_FEATURES = "div.highlight-feature, div.highlight-feature h3.features-spec-heading, div.highlight-feature li[data-qa=spec-value]"
_BREAKDOWN = "section#consumer-reviews div.ratings-breakdown div.review-text, section#consumer-reviews div.ratings-breakdown div.review-text strong"
LISTING_FIELDS = {
    "headline": Field("#vehicle-title"),
    "msrp": Field("div.msrp"),
    "list_price": Field(".list-price"),
    "monthly": Field("fuse-stack[data-qa=monthly-payment] fuse-button"),
    "specs_subtitle": Field("section#features-and-specs div.subtitle"),
    "basics": Field("div.basics li[data-qa=basics-entry]"),
    "history": Field("section#vehicle_history_report fuse-list ul li span"),
    "warranty": Field(_WARRANTY), "warranty_tags": Field(_WARRANTY, TAG),
    "images": Field("fuse-gallery-grid#gallery img", "src"),
    "features": Field(_FEATURES), "feature_tags": Field(_FEATURES, TAG),
    "seller_name": Field("div.dealer-info h3"),
    "seller_href": Field("div.dealer-info fuse-stack.rating-stack a", "href"),
    "seller_place": Field("div.dealer-info div.map-link a"),
    "seller_site": Field("div.dealer-info div.website a", "href"),
    "seller_rating": Field("fuse-stack.rating-stack fuse-rating", "rating"),
    "seller_reviews": Field("fuse-stack.rating-stack fuse-rating a"),
    "seller_highlights": Field("div.highlights-tab fuse-list ul li"),
    "seller_text": Field("div.about-tab__carsons-summary-body cars-line-clamp p"),
    "seller_images": Field("card-gallery.dealership-gallery img", "src"),
    "car_rating": Field("section#consumer-reviews div.rating-out-of span.rating-count"),
    "car_subtitle": Field("section#consumer-reviews div.subtitle"),
    "breakdown": Field(_BREAKDOWN), "breakdown_kinds": Field(_BREAKDOWN, WHICH),
    "review_href": Field("fuse-button.review-btn-secondary[href*=write-a-review]", "href"),
}
# The block of one consumer review and its fields.
REVIEW_BLOCK = "div.consumer-review-container"
_PARTS = ".ratings-breakdown fuse-stack .review-text, .ratings-breakdown fuse-stack .review-text strong"
_OLD_PARTS = ", ".join(f".review-breakdown--list li{part}" for part in ("", " .sds-definition-list__display-name", " .sds-definition-list__value"))
REVIEW_FIELDS = {
    "rating": Field("fuse-rating, spark-rating", "rating"),
    "date": Field(".review-date"),
    "byline": Field(".review-byline div"),
    "author": Field(".author-details div"),
    "headline": Field("h3.title"),
    "parts": Field(_PARTS), "part_kinds": Field(_PARTS, WHICH),
    "old_parts": Field(_OLD_PARTS), "old_part_kinds": Field(_OLD_PARTS, WHICH),
    "clamp": Field("cars-line-clamp"),
    "feedback": Field("cars-line-clamp .review-feedback"),
    "body": Field("p.review-body"),
}
# Fields of a dealer page.
_PHONES = "div.dealer-phone, div.dealer-phone span.phone-number-title, div.dealer-phone a.phone-number"
_HOURS = "table.dealer-hours tr, table.dealer-hours tr td"
DEALER_FIELDS = {"phones": Field(_PHONES), "phone_tags": Field(_PHONES, TAG), "hours": Field(_HOURS), "hours_tags": Field(_HOURS, TAG)}
# Vehicle number and stock number in the subtitle of the specification block.
VIN_TEXT = r"VIN:\s*([A-Z0-9]+)"
STOCK_TEXT = r"Stock #:\s*([A-Z0-9]+)"
REVIEW_SLUG = r"([^/]+)/write-a-review"


def _blocks(texts: str, tags: str, start: str) -> Column:
    """Arrays of (text, tag) structs, one for each element `start` and what follows up to the next one; `tags` may be names or `WHICH`."""
    both = F.transform(F.arrays_zip(texts, tags), lambda x: F.struct(x[texts].alias("text"), x[tags].alias("tag")))
    at = F.filter(F.transform(tags, lambda tag, i: F.when(tag == start, i + 1)), lambda i: i.isNotNull())
    end = F.size(tags) + 1
    return F.transform(at, lambda i, k: F.slice(both, i, F.coalesce(F.get(at, k + 1), end) - i))


def _all_of(block: Column, tag: str) -> Column:
    return F.transform(F.filter(block, lambda x: x["tag"] == tag), lambda x: x["text"])


def _first_of(block: Column, tag: str) -> Column:
    """Text of the first element of a name in a block, NULL when there is none or it is empty."""
    return F.nullif(F.get(_all_of(block, tag), F.lit(0)), F.lit(""))


def _map_of(entries: Column, value: str = "string") -> Column:
    """Map from (label, value) structs, later labels winning; NULL when there are none."""
    last_first = F.reverse(F.filter(entries, lambda e: e["label"].isNotNull()))
    unique = F.aggregate(
        last_first,
        F.array().cast(f"array<struct<label:string,value:{value}>>"),
        lambda acc, e: F.when(F.exists(acc, lambda x: x["label"] == e["label"]), acc).otherwise(F.array_append(acc, e)),
    )
    return F.when(F.size(unique) > 0, F.map_from_entries(F.reverse(unique)))


def _nonempty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _numbers(entries: Column) -> Column:
    """Map label -> number of the entries that have a value; a value that is no number is NULL."""
    found = _map_of(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.transform_values(found, lambda _, v: v.try_cast("double"))


def _labelled_numbers(texts: str, kinds: str) -> Column:
    """Map label -> number from elements (kind 0) that hold the label and, in an element of their own (kind 1), the number."""
    return _numbers(F.transform(_blocks(texts, kinds, "0"), lambda b: F.struct(
        F.trim(F.replace(b[0]["text"], F.coalesce(_first_of(b, "1"), F.lit("")), F.lit(""))).alias("label"), _first_of(b, "1").alias("value")
    )))


def listing_fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Selected fields of detail pages, with the review count read from the page text."""
    counted = pages.withColumn("review_count", patterns.review_count(F.col(html)))
    return extract_fields(counted, [key, "review_count"], html, LISTING_FIELDS)


def review_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, review struct): one row per consumer review that has a text or a title."""
    raw = extract_records(pages, [key], html, REVIEW_BLOCK, REVIEW_FIELDS)
    # A byline of two parts is date and author; newer pages mark both.
    who = patterns.byline(F.coalesce(first("author"), F.get("byline", F.lit(1))))
    clamp = F.when(F.size("clamp") > 0, F.replace(F.get("clamp", F.lit(0)), F.coalesce(first("feedback"), F.lit("\u0000")), F.lit("")))
    text = F.nullif(F.coalesce(clamp, first("body")), F.lit(""))
    # Label and value of one entry; an entry without either says nothing, and of equal labels the last counts.
    old = _numbers(F.filter(
        F.transform(_blocks("old_parts", "old_part_kinds", "0"), lambda b: F.struct(_first_of(b, "1").alias("label"), _first_of(b, "2").alias("value"))),
        lambda e: e["label"].isNotNull(),
    ))
    parts = F.coalesce(_labelled_numbers("parts", "part_kinds"), old)
    review = F.struct(
        first("rating").try_cast("double").alias("overall_rating"),
        F.coalesce(first("date"), first("byline")).alias("time"),
        who["name"].alias("user_name"), who["place"].alias("from"), first("headline").alias("title"),
        parts.alias("ratings_breakdown"), text.alias("review"),
    )
    return raw.select(key, review.alias("review")).filter(F.col("review.review").isNotNull() | F.col("review.title").isNotNull())


def listing_records(fields: DataFrame, key: str, site: str, images: int | None = None, seller_images: int | None = None) -> DataFrame:
    """(key, post, seller, car) structs of detail pages from `listing_fields`.

    `images` and `seller_images` look at that many pictures of a page only; without them all are kept.
    """
    head = patterns.condition_and_title(first("headline"))
    subtitle = first("specs_subtitle")

    def pair(label: Column, value: Column) -> Column:
        return F.struct(label.alias("label"), value.alias("value"))

    vin = patterns.extract(subtitle, VIN_TEXT)
    stock = patterns.extract(subtitle, STOCK_TEXT)
    numbers = F.array(
        pair(F.when(vin.isNotNull(), "VIN"), vin), pair(F.when(stock.isNotNull(), "Stock Number"), stock)
    )
    basics = F.concat(numbers, F.transform("basics", lambda x: patterns.value_and_label(x)))
    history = F.transform("history", patterns.history_class)
    # The text of a term is the first one after it in its list.
    warranty = F.flatten(F.transform(_blocks("warranty", "warranty_tags", "dl"), lambda dl: F.transform(
        F.filter(F.transform(dl, lambda x, i: F.struct(x["text"].alias("name"), x["tag"].alias("tag"), _first_of(F.slice(dl, i + 1, F.size(dl)), "dd").alias("text"))),
                 lambda x: (x["tag"] == "dt") & (x["name"] != "") & x["text"].isNotNull()),
        lambda x: pair(x["name"], cleaning.dash_to_null(x["text"])),
    )))
    grouped = F.transform(_blocks("features", "feature_tags", "div"), lambda block: F.struct(_first_of(block, "h3").alias("label"), _all_of(block, "li").alias("value")))
    shown = lambda name, most: F.transform(
        F.filter(F.col(name) if most is None else F.slice(name, 1, most), lambda x: x != ""), lambda x: urls.strip_query(x)
    )
    base = F.lit(site)
    seller_link = urls.absolutize(first("seller_href"), base)
    review_url = urls.absolutize(first("review_href"), base)
    slug = patterns.extract(review_url, REVIEW_SLUG)
    car_link = F.when(slug.isNotNull(), F.replace(review_url, F.lit("write-a-review/"), F.lit("")))
    post = F.struct(
        head["condition"].alias("new_used"), head["title"].alias("title"),
        cleaning.digits_to_int(first("list_price")).alias("price"),
        cleaning.digits_to_int(first("monthly")).alias("monthly_payment"),
        cleaning.digits_to_int(first("msrp")).alias("mileage"),
        _map_of(basics).alias("basic_desc"),
        _map_of(grouped, "array<string>").alias("feature_des"),
        _map_of(history).alias("user_history_des"),
        _map_of(warranty).alias("warranty_des"),
        _nonempty(shown("images", images)).alias("image"),
    )
    seller = F.struct(
        first("seller_name").alias("seller_name"), seller_link.alias("seller_link"),
        urls.last_path_segment(seller_link).alias("seller_key"),
        first("seller_place").alias("destination"), first("seller_site").alias("seller_website"),
        first("seller_rating").try_cast("double").alias("seller_rating"),
        patterns.first_grouped_int(first("seller_reviews")).alias("seller_rating_count"),
        _nonempty(F.filter("seller_highlights", lambda x: x != "")).alias("highlights"),
        first("seller_text").alias("description"),
        _nonempty(shown("seller_images", seller_images)).alias("image"),
    )
    car = F.struct(
        first("car_rating").try_cast("double").alias("car_rating"),
        F.col("review_count").alias("car_rating_count"),
        _labelled_numbers("breakdown", "breakdown_kinds").alias("ratings"),
        patterns.percentage(first("car_subtitle")).alias("percentage_recommend"),
        slug.alias("car_model"), urls.slug_brand(slug).alias("brand"), urls.slug_name(slug).alias("car_name"),
        car_link.alias("car_link"), F.concat(car_link, F.lit("consumer-reviews/?page_size=40")).alias("review_link"),
    )
    return fields.select(key, post.alias("post"), seller.alias("seller"), car.alias("car"))


def dealer_records(fields: DataFrame, key: str) -> DataFrame:
    """(key, phone_info, hours) maps of dealer pages."""
    phones = F.transform(_blocks("phones", "phone_tags", "div"), lambda block: F.struct(
        F.coalesce(_first_of(block, "span"), F.lit("Unknown")).alias("label"), _first_of(block, "a").alias("value")
    ))
    rows = F.filter(F.transform(_blocks("hours", "hours_tags", "tr"), lambda block: _all_of(block, "td")), lambda cells: F.size(cells) == 2)
    hours = F.transform(rows, lambda cells: F.struct(F.rtrim(cells[0], F.lit(":")).alias("label"), F.nullif(cells[1], F.lit("")).alias("value")))
    return fields.select(
        key, _map_of(F.filter(phones, lambda x: x["value"].isNotNull())).alias("phone_info"), _map_of(hours).alias("hours")
    )
