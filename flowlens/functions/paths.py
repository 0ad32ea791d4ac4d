"""Path, URI and companion-file expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a URI, and how a bucket link is read.
URI_PATTERN = r"^[A-z0-9]{2,}://"
BUCKET_PATTERN = r"^gs://([A-z0-9-]+)/(.*)"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the last path part; null without a dot or after a trailing one."""
    return F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit(""))


def scheme(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.startswith("http://") | p.startswith("https://"), "http")
        .when(p.startswith("gs://"), "gs")
        .when(p.startswith("s3://"), "s3")
        .otherwise("local")
    )


def strip_file_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^file://", "")


def bucket(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, BUCKET_PATTERN, 1), F.lit(""))


def blob(link: Column) -> Column:
    return F.when(link.rlike(BUCKET_PATTERN), F.regexp_extract(link, BUCKET_PATTERN, 2))


def companion(path: Column, pattern: Column) -> Column:
    """Companion of `path`: each leading `^` strips one extension, then the rest is appended.

    A path with fewer extensions than carets keeps its name once none is left, and a leading dot
    is part of the name.
    """
    carets = F.length(pattern) - F.length(F.ltrim(pattern, F.lit("^")))
    base = F.aggregate(
        F.when(carets > 0, F.sequence(F.lit(1), carets)).otherwise(F.array().cast("array<int>")),
        path,
        lambda acc, _: F.regexp_replace(acc, r"([^/])\.[^./]*$", "$1"),
    )
    return F.concat(base, F.ltrim(pattern, F.lit("^")))


def companion_suffix(pattern: Column) -> Column:
    """The pattern as it shows up in an input name: no carets, no dots."""
    return F.regexp_replace(pattern, r"[\^.]", "")


def qualify(path: Column, base: Column, home: Column) -> Column:
    """Absolute, normalised path against `base`; `~` is `home`; URIs are left alone."""
    expanded = (
        F.when(path == "~", home)
        .when(path.startswith("~/"), F.concat(F.rtrim(home, F.lit("/")), F.substring(path, 2, 1 << 30)))
        .otherwise(path)
    )
    full = F.when(expanded.startswith("/"), expanded).otherwise(F.concat_ws("/", base, expanded))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    root = F.when(full.rlike("^//(?!/)"), "//").otherwise("/")
    return (
        F.when(path.isNull(), F.lit(None).cast("string"))
        .when(path.rlike(URI_PATTERN), path)
        .otherwise(F.concat(root, F.array_join(stack, "/")))
    )


def cache_key(source: Column, modified: Column) -> Column:
    """`md5(source + last-modified)_basename`."""
    return F.concat(
        F.md5(F.concat(source, F.coalesce(modified, F.lit("")))), F.lit("_"), basename(source)
    )
