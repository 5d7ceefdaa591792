"""File names, volume paths and links as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ROOT = "Volumes"


def file_extension(name: Column) -> Column:
    """Lower-case extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1))


def safe_filename(name: Column) -> Column:
    """Spaces and every other character that is not a letter, number, '_' or '-'
    become '_' in the stem; the last extension stays as it is. A name's leading
    dots do not start an extension."""
    spaced = F.replace(name, F.lit(" "), F.lit("_"))
    split = r"(?s)^((?:.*/)?\.*[^./][^/]*?)(\.[^./]*)$"
    extension = F.regexp_extract(spaced, split, 2)
    stem = F.when(extension == "", spaced).otherwise(F.regexp_extract(spaced, split, 1))
    return F.concat(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-]", "_"), extension)


def volume_file_path(catalog: Column, schema: Column, volume: Column, name: Column) -> Column:
    """Absolute path of a file in a volume."""
    return F.concat_ws("/", F.lit(""), F.lit(ROOT), catalog, schema, volume, name)


def path_segments(path: Column) -> Column:
    return F.split(F.btrim(path, F.lit("/")), "/")


def is_volume_path(path: Column) -> Column:
    parts = path_segments(path)
    return F.coalesce((F.size(parts) >= 4) & (F.get(parts, 0) == ROOT), F.lit(False))


def volume_parts(path: Column) -> Column:
    """struct(catalog, schema, volume_name, full_path), NULL for other paths."""
    parts = path_segments(path)
    return F.when(
        is_volume_path(path),
        F.struct(
            F.get(parts, 1).alias("catalog"),
            F.get(parts, 2).alias("schema"),
            F.get(parts, 3).alias("volume_name"),
            path.alias("full_path"),
        ),
    )


def image_output_path(path: Column) -> Column:
    """Folder for page images next to the file, NULL for other paths."""
    parts = path_segments(path)
    return F.when(
        is_volume_path(path),
        F.concat_ws("/", F.lit(""), F.lit(ROOT), F.get(parts, 1), F.get(parts, 2), F.get(parts, 3),
                    F.lit("parsed_images"), F.lit("")),
    )


def percent_encode(value: Column) -> Column:
    """Percent-encode for a URL, keeping '/' and the unreserved characters."""
    encoded = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


# where a file of a volume is shown: a page address with places for its parts
LINK = "{host}/files/{catalog}/{schema}/{volume}/{inner}?workspace={workspace}"


def volume_link(path: Column, inner: Column, host: str, workspace: str, template: str = LINK) -> Column:
    """Browser link to ``inner`` inside the volume that ``path`` names."""
    parts = path_segments(path)
    values = {
        "host": F.lit(host), "workspace": F.lit(workspace), "inner": inner,
        "catalog": F.get(parts, 1), "schema": F.get(parts, 2), "volume": F.get(parts, 3),
    }
    pieces = [
        F.coalesce(values[p[1:-1]], F.lit("")) if p[1:-1] in values and p[0] == "{" else F.lit(p)
        for p in re.split(r"(\{\w+\})", template) if p
    ]
    return F.when(is_volume_path(path), F.concat(*pieces))


def document_link(path: Column, filename: Column, host: str, workspace: str, template: str = LINK) -> Column:
    """Link to a landed document: the path's fifth segment, else its file name."""
    fifth = F.get(path_segments(path), 4)
    return volume_link(path, F.coalesce(fifth, filename, F.lit("")), host, workspace, template)


def log_file_path(base: Column, started: Column, run_id: Column) -> Column:
    """{base}/{date}/{run}.log"""
    return F.concat(base, F.lit("/"), F.date_format(started, "yyyy-MM-dd"), F.lit("/"), run_id, F.lit(".log"))


def log_link(
    path: Column, created: Column, file_id: Column, base: str, host: str, workspace: str, template: str = LINK
) -> Column:
    """Link to a log: from its stored path, else from the date and id of the record."""
    derived = log_file_path(F.lit(base), created, file_id)
    used = F.coalesce(F.nullif(path, F.lit("")), derived)
    parts = path_segments(used)
    inner = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1))), "/")
    return volume_link(used, inner, host, workspace, template)
