"""Scalar column functions (F1-F16). All are built-in expressions: they stay inside whole-stage
codegen and never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes routed to the page/image converter, image file extensions, statuses
PAGE_IMAGE_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg"]
TERMINAL_STATUSES = ["completed", "failed", "cancelled"]
# fixed values: leading-byte signatures (hex) and the format each one means
MAGIC_PREFIXES = [("25504446", "pdf"), ("FFD8FF", "jpg"), ("89504E47", "png"),
                  ("D0CF11E0", "ole"), ("504B0304", "zip")]
# fixed values: status messages of the result endpoints
MSG_NOT_READY = "Task is in {status} status, data not available yet"
MSG_CLEANED = "Task completed but result files have been cleaned up (older than retention period)"
MSG_NO_DIR = "Result directory does not exist"
IMAGE_REF_PATTERN = r"!\[([^\]]*)\]\(([^)]+)\)"

_WS = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def file_suffix(name) -> Column:
    """last ``.ext`` of the base name, lower-cased; dotfiles and names without a dot give ''."""
    return F.lower(F.regexp_extract(basename(name), r"^.+(\.[^.]+)$", 1))


def file_stem(name) -> Column:
    """base name without its last suffix (``a.tar.gz`` -> ``a.tar``, ``.bashrc`` kept)."""
    return F.regexp_extract(basename(name), r"^(.+?)(\.[^.]+)?$", 1)


def pdf_name_v1(name) -> Column:
    """text before the first dot plus ``.pdf``."""
    return F.concat(F.substring_index(_c(name), ".", 1), F.lit(".pdf"))


def route_by_suffix(name) -> Column:
    """``page_image`` for page/image suffixes, ``text_like`` for everything else."""
    return F.when(file_suffix(name).isin(PAGE_IMAGE_SUFFIXES), "page_image").otherwise("text_like")


def sniff_format(content) -> Column:
    """format from the leading bytes; ``unsupported`` otherwise."""
    head = F.hex(F.substring(_c(content), 1, 8))
    expr = None
    for magic, fmt in MAGIC_PREFIXES:
        cond = F.startswith(head, F.lit(magic))
        expr = F.when(cond, fmt) if expr is None else expr.when(cond, fmt)
    return expr.otherwise("unsupported")


def b64_encode(data) -> Column:
    """base64 without line breaks (Spark may chunk lines)."""
    return F.regexp_replace(F.base64(_c(data)), r"[\r\n]", "")


def b64_decode(text) -> Column:
    """base64 text to bytes; NULL on malformed input."""
    return F.try_to_binary(_c(text), F.lit("base64"))


def data_uri(data, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), b64_encode(data))


def image_refs(md) -> Column:
    """array of structs (alt, path, name) for every Markdown image reference, in text order."""
    alts = F.regexp_extract_all(_c(md), F.lit(IMAGE_REF_PATTERN), 1)
    paths = F.regexp_extract_all(_c(md), F.lit(IMAGE_REF_PATTERN), 2)
    matches = F.regexp_extract_all(_c(md), F.lit(IMAGE_REF_PATTERN), 0)
    return F.transform(
        F.arrays_zip(matches.alias("match"), alts.alias("alt"), paths.alias("path")),
        lambda r: F.struct(r["match"].alias("match"), r["alt"].alias("alt"), r["path"].alias("path"),
                           basename(r["path"]).alias("name")),
    )


def img_tag(url, alt) -> Column:
    return F.concat(F.lit('<img src="'), _c(url), F.lit('" alt="'), _c(alt), F.lit('">'))


def rewrite_refs(md, resolved) -> Column:
    """F8: replace each resolved ``(match, html)`` in order; unresolved refs stay verbatim."""
    return F.aggregate(_c(resolved), _c(md), lambda acc, r: F.replace(acc, r["match"], r["html"]))


def split_fields(text, sep: str = ",") -> Column:
    """split on ``sep`` and strip surrounding whitespace."""
    return F.transform(F.split(_c(text), F.lit(sep)), lambda x: F.regexp_replace(x, _WS, ""))


def minutes_before(now: Column, minutes) -> Column:
    """``now - N minutes`` (callers compare with strict ``<``)."""
    return now - F.make_dt_interval(mins=F.lit(minutes))


def days_before(now: Column, days) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def iso_time(ts) -> Column:
    """ISO-8601 text; fraction only when non-zero, like ``datetime.isoformat``."""
    t = _c(ts)
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


WORKER_ID_PATTERN = r"^([^-]+)-(.*)-([^-]+)-(\d+)$"


def worker_id(prefix, host, device, pid) -> Column:
    """compose ``prefix-host-device-pid``."""
    return F.concat_ws("-", _c(prefix), _c(host), _c(device), _c(pid).cast("string"))


def worker_id_parts(wid) -> Column:
    """parse from both ends (the host may contain '-'); NULL fields when it does not fit."""
    w = _c(wid)
    ok = w.rlike(WORKER_ID_PATTERN)
    return F.struct(*[F.when(ok, F.regexp_extract(w, WORKER_ID_PATTERN, i)).alias(n)
                      for i, n in enumerate(["prefix", "host", "device", "pid"], start=1)])


def object_name(key, name) -> Column:
    """Deterministic object name ``images/{sha256(key/name)}{ext}`` (replay-safe)."""
    return F.concat(F.lit("images/"), F.sha2(F.concat_ws("/", _c(key).cast("string"), _c(name)), 256),
                    file_suffix(name))


def object_url(endpoint: str, bucket: str, obj, scheme: str = "http") -> Column:
    """``scheme://endpoint/bucket/object``."""
    return F.concat(F.lit(f"{scheme}://{endpoint}/{bucket}/"), _c(obj))


def formula_spans(md, display=("$$", "$$"), inline=("$", "$")) -> Column:
    """display formulas first, then inline ones in the text with display spans removed."""
    disp_pat = F.lit(_quote(display[0]) + "(.+?)" + _quote(display[1]))
    inl_pat = F.lit(_quote(inline[0]) + "([^$]+?)" + _quote(inline[1]))
    rest = F.regexp_replace(_c(md), disp_pat, " ")
    return F.struct(F.regexp_extract_all(_c(md), disp_pat, 1).alias("display"),
                    F.regexp_extract_all(rest, inl_pat, 1).alias("inline"))


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in s)


def resolve_parse_mode(method, needs_ocr) -> Column:
    """``ocr``/``txt`` forced; anything else decided by the classifier flag."""
    m = _c(method)
    return F.when(m.isin("ocr", "txt"), m).when(_c(needs_ocr), "ocr").otherwise("txt")


def is_terminal(status) -> Column:
    """B9."""
    return _c(status).isin(TERMINAL_STATUSES)


def status_message(status, result_path, has_files) -> Column:
    """F16: why a task has no data (NULL when it has)."""
    s = _c(status)
    not_ready = F.replace(F.lit(MSG_NOT_READY), F.lit("{status}"), s)
    return (F.when(s != "completed", not_ready)
            .when(_c(result_path).isNull(), MSG_CLEANED)
            .when(~F.coalesce(_c(has_files), F.lit(False)), MSG_NO_DIR))
