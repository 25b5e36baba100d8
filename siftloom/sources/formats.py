"""File types: how a name or media type, and the first bytes, tell what a file is."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FileType:
    key: str
    mimes: tuple[str, ...]
    extensions: tuple[str, ...]
    hint: str
    magic: tuple[bytes, ...] = ()
    within: int = 1024


# The types that are read.
TYPES = (
    FileType("pdf", ("application/pdf",), ("pdf",), "prose", (b"%PDF-",)),
    FileType("docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), ("docx",), "prose", (b"PK\x03\x04",)),
    FileType("xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), ("xlsx",), "tabular", (b"PK\x03\x04",)),
    FileType("pptx", ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), ("pptx",), "structured", (b"PK\x03\x04",)),
    FileType("odt", ("application/vnd.oasis.opendocument.text",), ("odt",), "prose", (b"PK\x03\x04",)),
    FileType("epub", ("application/epub+zip",), ("epub",), "prose", (b"PK\x03\x04",)),
    FileType("rtf", ("application/rtf", "text/rtf"), ("rtf",), "prose", (b"{\\rtf",), 8),
    FileType("html", ("text/html", "application/xhtml+xml"), ("html", "htm"), "prose"),
    FileType("xml", ("application/xml", "text/xml"), ("xml",), "structured"),
    FileType("json", ("application/json",), ("json",), "structured"),
    FileType("yaml", ("application/yaml", "text/yaml"), ("yaml", "yml"), "structured"),
    FileType("toml", ("application/toml",), ("toml",), "structured"),
    FileType("csv", ("text/csv",), ("csv",), "tabular"),
    FileType("md", ("text/markdown",), ("md", "markdown"), "prose"),
    FileType("txt", ("text/plain",), ("txt", "log"), "prose"),
    FileType("eml", ("message/rfc822",), ("eml",), "prose"),
    FileType("srt", ("application/x-subrip",), ("srt",), "media"),
    FileType("vtt", ("text/vtt",), ("vtt",), "media"),
    FileType("image", ("image/png", "image/jpeg", "image/tiff"), ("png", "jpg", "jpeg", "tif", "tiff"), "media", (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\0", b"MM\0*"), 8),
    FileType("code", ("text/x-python", "text/x-java", "text/x-c"), ("py", "java", "c", "js", "ts", "go", "rs"), "code"),
)
GENERIC = ("application/octet-stream", "text/plain", "application/zip", "")


def resolve(mime: str | None, name: str | None) -> FileType | None:
    """The type of a media type, or of the name's extension where that says little or nothing."""
    bare = (mime or "").partition(";")[0].strip().lower()
    by_mime = next((t for t in TYPES if bare in t.mimes), None)
    if by_mime and bare not in GENERIC:
        return by_mime
    ending = (name or "").rpartition(".")[2].lower()
    return next((t for t in TYPES if ending in t.extensions), by_mime)


def signed(data: bytes, kind: FileType) -> bool:
    """Whether a signature of the type lies within the first bytes where that type has it."""
    return any(m in data[: kind.within] for m in kind.magic)


def matches(data: bytes, declared: FileType) -> bool:
    """Whether the first bytes fit the declared type: they hold its signature if it has one, and no other type's that differs from it.

    Types of one container share a signature and cannot be told apart by it.
    """
    if declared.magic and not signed(data, declared):
        return False
    kin = lambda other: any(a.startswith(b) or b.startswith(a) for a in declared.magic for b in other.magic)
    return not any(signed(data, t) for t in TYPES if t.key != declared.key and not kin(t))
