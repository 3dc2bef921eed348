"""URL pieces and model slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def last_path_segment(url: Column) -> Column:
    """Last non-empty piece between slashes, without the fragment; NULL when there is none."""
    pieces = F.filter(F.split(strip_fragment(url), "/"), lambda x: x != "")
    return F.try_element_at(pieces, F.lit(-1))


def site_root(url: Column) -> Column:
    """`scheme://host` of an absolute URL."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def absolutize(href: Column, base: Column) -> Column:
    """Resolve a link against the page URL: absolute, scheme-relative, rooted, query, fragment or sibling."""
    root = site_root(base)
    scheme = F.substring_index(base, ":", 1)
    page = strip_query(strip_fragment(base))
    # Everything up to the last slash of the path; a base without a path gets one.
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.isNull() | (href == ""), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(strip_fragment(base), href))
        .otherwise(F.concat(folder, href))
    )


def slug_parts(slug: Column) -> Column:
    return F.split(slug, "-")


def slug_brand(slug: Column) -> Column:
    """First dash-separated part, underscores as blanks, in title case."""
    return F.initcap(F.replace(F.get(slug_parts(slug), F.lit(0)), F.lit("_"), F.lit(" ")))


def slug_year(slug: Column) -> Column:
    """Trailing four-digit part of the slug as a number."""
    return F.regexp_extract(slug, r"(?:^|-)(\d{4})$", 1).try_cast("int")


def slug_name(slug: Column) -> Column:
    """Readable name: the year, if the slug ends with one, then the other parts in title case."""
    stem = F.when(slug_year(slug).isNotNull(), F.regexp_replace(slug, r"(^|-)\d{4}$", "")).otherwise(slug)
    words = F.initcap(F.array_join(slug_parts(stem), " "))
    return F.when(slug.isNotNull(), F.concat_ws(" ", slug_year(slug).cast("string"), words))


def slug_of(text: Column) -> Column:
    """Dash-joined lower-case form of a display text."""
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-"))
