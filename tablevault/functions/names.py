"""Names of backups and of protected targets (N1-N6, N8) as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default backup file name pattern, and the file extension per compression.
DEFAULT_PATTERN = "db_backup_{{ .now }}.{{ .compression }}"
EXTENSIONS = {"gzip": "tgz", "bzip2": "tbz2", "none": "tar"}

# Fixed value: what a Go template prints for a key missing from its map.
MISSING_KEY = "<no value>"

# Fixed value: the file name pattern retention understands; the zone suffix is matched.
BACKUP_NAME_RE = (
    r"^db_backup_(\d{4})-(\d{2})-(\d{2})T(\d{2})[:-](\d{2})[:-](\d{2})(Z|[\-\+]\d{2}[:-]\d{2})\.\w+$"
)

_KEY_RE = re.compile(r"\{\{\s*\.(\w+)\s*\}\}")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(codec) -> Column:
    """Archive extension by compression name; an unknown name fails the job."""
    c = _col(codec)
    m = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    ext = F.element_at(m, c)
    return F.when(ext.isNotNull(), ext).otherwise(
        F.raise_error(F.concat(F.lit("unknown compression: "), F.coalesce(c, F.lit("null")))))


def safe_name(c) -> Column:
    """``:`` -> ``-`` (for targets that cannot hold a colon)."""
    return F.replace(_col(c), F.lit(":"), F.lit("-"))


def timestamp_part(ts, safe: bool | Column = False) -> Column:
    """The run's time as RFC 3339 in UTC (``2024-01-01T00:00:07Z``), ``:`` -> ``-`` when safe."""
    text = F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(safe, bool):
        return safe_name(text) if safe else text
    return F.when(safe, safe_name(text)).otherwise(text)


def backup_name(ts, ext, pattern: str | None = None, safe: bool | Column = False) -> Column:
    """File name from a pattern with keys now, year ... second, compression.

    The pattern is a parameter, parsed once on the driver into literal pieces and key columns; an
    empty pattern means the default one. A key the template does not know prints ``<no value>``.
    """
    pattern = pattern or DEFAULT_PATTERN
    t = _col(ts)
    values = {
        "now": timestamp_part(t, safe),
        "year": F.date_format(t, "yyyy"),
        "month": F.date_format(t, "MM"),
        "day": F.date_format(t, "dd"),
        "hour": F.date_format(t, "HH"),
        "minute": F.date_format(t, "mm"),
        "second": F.date_format(t, "ss"),
        "compression": _col(ext) if not isinstance(ext, str) else F.lit(ext),
    }
    parts: list[Column] = []
    pos = 0
    for m in _KEY_RE.finditer(pattern):
        if m.start() > pos:
            parts.append(F.lit(pattern[pos:m.start()]))
        parts.append(values.get(m.group(1), F.lit(MISSING_KEY)))
        pos = m.end()
    if pos < len(pattern):
        parts.append(F.lit(pattern[pos:]))
    if "{{" in _KEY_RE.sub("", pattern):
        raise ValueError(f"failed to parse filename pattern: {pattern!r}")
    return F.concat(*parts) if parts else F.lit("")


def base_name(path) -> Column:
    """Last element of a path (``a/b/c.tgz`` -> ``c.tgz``), trailing slashes ignored."""
    return F.substring_index(F.regexp_replace(_col(path), "/+$", ""), "/", -1)


def name_time_of_base(b: Column, zone_aware: bool = False) -> Column:
    """N4 on a base name already extracted (see :func:`name_time`)."""
    # once the pattern matches, every field sits at a fixed offset:
    # db_backup_YYYY-MM-DDTHH?MM?SS<zone>.<ext>   (? is ':' or '-')
    text = F.concat(F.substring(b, 11, 10), F.lit(" "), F.translate(F.substring(b, 22, 8), "-", ":"))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    if zone_aware:
        zone = F.regexp_extract(b, BACKUP_NAME_RE, 7)
        sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
        mins = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int"))
        offset = F.when(zone == "Z", F.lit(0)).otherwise(sign * mins)
        parsed = parsed - F.make_dt_interval(mins=offset)
    return F.when(b.rlike(BACKUP_NAME_RE), parsed)


def name_time(filename, zone_aware: bool = False) -> Column:
    """Time from a standard backup name, null when it does not match or is no real date.

    The zone suffix is matched but, as in the reference, ignored: the time is read as UTC.
    ``zone_aware=True`` applies the offset instead. Result type: TIMESTAMP_NTZ (UTC wall time).
    """
    return name_time_of_base(base_name(filename), zone_aware)


def target_identity(mode, native_id, dbs) -> Column:
    """``mysql:{mode}:{native_id}[:sorted dbs]``; names only in include / exclude mode."""
    m = _col(mode)
    sorted_dbs = F.array_sort(_col(dbs))
    base = F.concat_ws(":", F.lit("mysql"), m, F.coalesce(_col(native_id), F.lit("")))
    with_dbs = F.concat_ws(":", base, F.array_join(sorted_dbs, ":"))
    use = m.isin("include", "exclude") & (F.size(_col(dbs)) > 0)
    return F.when(use, with_dbs).otherwise(base)


def selection_mode(include, exclude) -> Column:
    """include list non-empty -> include; else exclude non-empty -> exclude; else all."""
    inc, exc = _col(include), _col(exclude)
    return (F.when(F.coalesce(F.size(inc), F.lit(0)) > 0, F.lit("include"))
            .when(F.coalesce(F.size(exc), F.lit(0)) > 0, F.lit("exclude"))
            .otherwise(F.lit("all")))


def parse_target(url) -> Column:
    """``struct(scheme, host, path)`` of a target URL; a leading ``/`` means ``file://``."""
    u = _col(url)
    full = F.when(u.startswith("/"), F.concat(F.lit("file://"), u)).otherwise(u)
    return F.struct(
        F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1).alias("host"),
        F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1).alias("path"),
    )
