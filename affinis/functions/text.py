"""Strings, identifiers, addresses and content types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Content types by file extension, in natural order (fixed values of public registries).
EXTENSIONS = {
    "avi": "video/x-msvideo", "bmp": "image/bmp", "csv": "text/csv", "gif": "image/gif", "htm": "text/html", "html": "text/html",
    "jpeg": "image/jpeg", "jpg": "image/jpeg", "json": "application/json", "mov": "video/quicktime", "mp4": "video/mp4", "mpeg": "video/mpeg",
    "npy": "application/octet-stream", "pdf": "application/pdf", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "txt": "text/plain", "xml": "text/xml", "zip": "application/zip",
}


def partition(text: Column, parts: int) -> Column:
    """``parts`` segments of nearly equal length, the earlier ones longer; fails if the text is shorter than that."""
    n = F.char_length(text)
    base, extra = F.floor(n / parts).cast("int"), n % parts
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, (i * base + F.least(i, extra) + 1).cast("int"), (base + F.when(i < extra, 1).otherwise(0)).cast("int")))
    return F.when(n >= parts, pieces).otherwise(F.raise_error(F.lit("more parts than characters")))


def url_join(*segments: Column) -> Column:
    """Segments with one slash between them.

    One that begins with a scheme or a slash drops all before it; of a run of leading slashes one stays and
    trailing ones go. Empty segments are passed over, but an empty last one ends the result with a slash.
    """
    scheme = r"^\w+://"
    out = F.lit("")
    for s in segments:
        bare = F.regexp_replace(s, "/+$", "")
        tail = F.regexp_replace(F.regexp_replace(s, scheme, ""), "/+$", "")
        joined = F.when((out == "") | out.endswith("/"), F.concat(out, bare)).otherwise(F.concat(out, F.lit("/"), bare))
        out = F.when(s == "", out).when(s.rlike(scheme), F.concat(F.regexp_extract(s, scheme, 0), tail)).when(s.startswith("/"), F.concat(F.lit("/"), F.regexp_replace(s, "^/+|/+$", ""))).otherwise(joined)
    return F.when((segments[-1] == "") & (out != ""), F.concat(out, F.lit("/"))).otherwise(out)


def content_type(path: Column) -> Column:
    """Type of a path's extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def from_base64_url(code: Column) -> Column:
    """Bytes of URL-safe base64."""
    return F.unbase64(F.translate(code, "-_", "+/"))


def to_base64_url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def source_of(uri: Column) -> Column:
    """Which kind of element a URI names: the first that accepts it."""
    return (
        F.when(uri.startswith("base64://") | uri.rlike(r"^data:[^;,]*;base64,"), "memory").when(uri.rlike(r"^file:///") | uri.rlike(r"^/"), "file").when(uri.rlike("^https?://"), "url")
        .when(uri.startswith("psql://"), "postgres").when(uri.startswith("hbase://"), "hbase").when(uri.startswith("girder"), "girder").otherwise(F.lit(None).cast("string"))
    )


def content_ids(content: Column) -> dict[str, Column]:
    """Hashes that identify a content; the SHA-1 is an element's id."""
    return {"uid": F.sha1(content), "md5": F.md5(content), "sha512": F.sha2(content, 512)}


def random_characters(n: int, *seed: Column, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> Column:
    """``n`` characters that follow from ``seed``: the same seed gives the same ones."""
    return F.concat(*[F.substring(F.lit(letters), (F.crc32(F.concat_ws(":", *[s.cast("string") for s in seed], F.lit(str(i)))) % len(letters)).cast("int") + 1, F.lit(1)) for i in range(n)])


def json_list(text: Column) -> Column:
    """Strings of a JSON list; fails on what is no list, null stays null."""
    trimmed = F.trim(text)
    whole = trimmed.startswith("[") & trimmed.endswith("]")
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(whole & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("not a JSON list")))


def detection_uid(uid: Column, low: Column, high: Column, labels: Column) -> Column:
    """Id of a detection: SHA-1 of its element's uid, its box and its labels in order."""
    corners = F.array_join(F.transform(F.concat(low, high), lambda x: F.format_string("%.6f", x.cast("double"))), ",")
    return F.sha1(F.concat_ws("|", uid, corners, F.array_join(F.array_sort(labels), ",")))
