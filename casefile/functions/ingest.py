"""Ingest expressions: types of files, names, checks, encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile.functions.text import col

# They must be these for results to agree.
MIME_TYPES = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain", "text/csv", "text/html", "application/rtf",
    "image/jpeg", "image/png", "image/gif", "image/tiff", "image/bmp", "image/webp",
    "audio/mpeg", "audio/wav", "audio/ogg", "audio/flac", "audio/mp4", "audio/x-m4a",
    "video/mp4", "video/mpeg", "video/quicktime", "video/x-msvideo", "video/webm",
    "message/rfc822", "application/mbox", "application/zip", "application/x-tar", "application/gzip",
]
EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".txt", ".csv", ".html", ".rtf",
    ".jpg", ".jpeg", ".png", ".gif", ".tiff", ".tif", ".bmp", ".webp",
    ".mp3", ".wav", ".ogg", ".flac", ".m4a", ".aac",
    ".mp4", ".mpeg", ".mpg", ".mov", ".avi", ".webm", ".mkv",
    ".eml", ".mbox", ".msg", ".zip", ".tar", ".gz", ".tar.gz",
]
BAD_NAMES = [r"\.\.", r"[<>:\"|?*]", r"[\x00-\x1f]", r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"]
SIGNATURES = [
    ("25504446", [".pdf"]), ("89504E47", [".png"]), ("FFD8FF", [".jpg", ".jpeg"]), ("474946383761", [".gif"]), ("474946383961", [".gif"]), ("504B0304", [".zip", ".docx", ".xlsx", ".pptx"]),
    ("494433", [".mp3"]), ("FFFB", [".mp3"]), ("FFFA", [".mp3"]), ("52494646", [".wav", ".avi"]), ("00000018667479706D7034", [".mp4", ".m4a"]), ("0000001C66747970", [".mp4", ".m4a", ".mov"]), ("0000002066747970", [".mp4", ".m4a"]),
]
DOCUMENT_TYPES = {".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".xlsx": "xlsx", ".xls": "xls", ".pptx": "pptx", ".rtf": "rtf", ".odt": "odt", ".txt": "text", ".csv": "csv"}
MAX_BYTES = 500 * 1024 * 1024


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"[^/]*$", 0)


def extension(path: Column | str) -> Column:
    """The last suffix in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.?(\.[^./]+)$", 1))


def type_of_extension(path: Column | str) -> Column:
    """SRC5."""
    e = extension(path)
    return F.when(e.isin(".jpg", ".jpeg", ".png", ".tiff", ".bmp"), "image").when(e.isin(".wav", ".mp3", ".ogg", ".flac"), "audio").when(e.isin(".eml", ".msg"), "email").otherwise("text")


def document_kind_of_extension(path: Column | str) -> Column:
    """SRC5, for folders of documents."""
    e = extension(path)
    return F.when(e == ".pdf", "document").when(e.isin(".png", ".jpg", ".jpeg", ".tiff", ".bmp"), "image").when(e.isin(".txt", ".md"), "text").otherwise("document")


def type_of_mime(mime: Column | str) -> Column:
    """SRC6."""
    m = F.coalesce(col(mime), F.lit(""))
    return F.when(F.startswith(m, F.lit("image")), "image").when(F.startswith(m, F.lit("audio")), "audio").when(F.contains(m, F.lit("pdf")), "document").otherwise("text")


def document_type(content: Column | str, path: Column | str) -> Column:
    """SRC7: by the first bytes, then by extension. Entry names stand uncompressed in ZIP files."""
    c = col(content)
    has = lambda s: F.contains(c, F.lit(s).cast("binary"))
    early = lambda s: F.contains(F.substring(c, 1, 2048), F.lit(s).cast("binary"))
    head = lambda n: F.coalesce(F.hex(F.substring(c, 1, n)), F.lit(""))
    zipped = head(4) == "504B0304"
    ole = head(8) == "D0CF11E0A1B11AE1"
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv]), extension(path))
    return (
        F.when(head(4) == "25504446", "pdf")
        .when(zipped & has("word/"), "docx").when(zipped & has("xl/"), "xlsx").when(zipped & has("ppt/"), "pptx").when(zipped & has("content.xml"), "odt")
        .when(ole & early("Word.Document"), "doc").when(ole & (early("Workbook") | early("Book")), "xls").when(ole, "doc")
        .when(head(5) == "7B5C727466", "rtf")
        .otherwise(F.coalesce(by_name, F.lit("unknown")))
    )


def upload_error(name: Column | str, mime: Column | str, size: Column | str, content: Column | str | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """SRC8: the first rule that an upload breaks; null if none."""
    n, m, e = col(name), col(mime), extension(name)
    bad = F.lit(False)
    for pattern in BAD_NAMES:
        bad = bad | F.regexp_like(n, F.lit("(?i)" + pattern))
    rules = [
        F.when(bad, "Filename contains invalid characters or patterns"),
        F.when(F.length(n) > 255, "Filename too long (max 255 characters)"),
        F.when(e == "", "File must have an extension"),
        F.when(~e.isin(EXTENSIONS), F.concat(F.lit("File type '"), e, F.lit("' is not allowed"))),
        F.when(col(size) > max_bytes, f"File size exceeds maximum allowed ({max_bytes // (1024 * 1024)}MB)"),
        F.when((F.coalesce(m, F.lit("")) != "") & ~m.isin(MIME_TYPES), F.concat(F.lit("Content type '"), m, F.lit("' is not allowed"))),
    ]
    if content is not None:
        c = F.hex(F.substring(col(content), 1, 16))
        wrong = F.lit(None).cast("string")
        for magic, names in reversed(SIGNATURES):
            wrong = F.when(F.startswith(c, F.lit(magic)), F.when(~e.isin(names), F.concat(F.lit("File content does not match extension '"), e, F.lit("'")))).otherwise(wrong)
        rules.append(F.when(F.length(col(content)) >= 8, wrong))
    return F.coalesce(*rules)


def safe_name(path: Column | str) -> Column:
    """SRC9: the name without folders and signs that file systems refuse, 200 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(base_name(path), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    suffix = F.regexp_extract(clean, r"[^.]\.?(\.[^./]+)$", 1)
    stem = F.substr(clean, F.lit(1), F.length(clean) - F.length(suffix))
    cut = F.when(F.length(clean) > 200, F.concat(F.substr(stem, F.lit(1), F.lit(200) - F.length(suffix)), suffix)).otherwise(clean)
    return F.when(cut == "", "unnamed_file").otherwise(cut)


def storage_path(case_id: Column | str, sha256: Column | str, path: Column | str) -> Column:
    """SRC9."""
    return F.concat_ws("/", F.regexp_replace(col(case_id), r"[^a-fA-F0-9-]", ""), F.concat(F.substring(F.regexp_replace(col(sha256), r"[^a-fA-F0-9]", ""), 1, 16), F.lit("_"), safe_name(path)))


def clean_text(text: Column | str, most: int = 10_000) -> Column:
    """SRC10: trimmed, cut, without control characters, signs of HTML escaped."""
    t = F.substring(F.regexp_replace(col(text), r"(?U)^\s+|\s+$", ""), 1, most)
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(sign), F.lit(entity))
    return t


def valid_case_number(number: Column | str) -> Column:
    """SRC10."""
    return F.regexp_like(col(number), F.lit(r"^[A-Za-z0-9\-_./]+$"))


def encrypted(content: Column | str, key: Column, id_: Column | str, iv: Column | None = None) -> Column:
    """SRC11: AES-256-GCM; nonce (12 bytes), ciphertext, tag (16 bytes); bound to the id. A nonce
    of the caller's must never repeat under one key; without one a random nonce is drawn."""
    data, aad = col(content).cast("binary"), col(id_).cast("binary")
    if iv is None:
        iv = F.unhex(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24))
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def decrypted(content: Column | str, key: Column, id_: Column | str) -> Column:
    """SRC11: null for a wrong key, id or damaged bytes."""
    return F.try_aes_decrypt(col(content), key, F.lit("GCM"), F.lit("DEFAULT"), col(id_).cast("binary"))


def needs_ocr(kind: Column, text: Column | str) -> Column:
    """FIL6: images and documents whose text is still missing."""
    return (F.coalesce(col(text), F.lit("")) == "") & kind.isin("image", "document", "mixed")


def intake_error(text: Column | str, raw: Column | str) -> Column:
    """FIL5: rows without content keep flowing with this error."""
    return F.when((F.coalesce(col(text), F.lit("")) == "") & (F.coalesce(F.length(col(raw)), F.lit(0)) == 0), "Evidence packet has no content")


# The stages of each evidence type.
ROUTES = {
    "text": ["behavioral", "fusion"],
    "image": ["image", "ocr", "behavioral", "fusion"],
    "audio": ["audio", "behavioral", "fusion"],
    "video": ["video", "behavioral", "fusion"],
    "document": ["document", "ocr", "behavioral", "fusion"],
    "email": ["email", "behavioral", "fusion"],
    "mixed": ["document", "ocr", "behavioral", "fusion"],
}


def route(kind: Column) -> Column:
    """FIL8: the stages that apply."""
    return F.element_at(F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]), F.when(kind.isin(list(ROUTES)), kind).otherwise("text"))
