"""Media types, ids and addresses."""

from __future__ import annotations

from pageloom.functions import text
from pageloom.functions.urls import extension, strip_query
from pageloom.functions.vocab import MIME

#: Folder of the job for files that it has fetched.
MEDIA_FOLDER = "media"
TYPE_OF = f"map({', '.join(text(x) for ext, kind, _ in MIME for x in (ext, kind))})"
CANONICAL_OF = f"map({', '.join(text(x) for ext, _, short in MIME for x in (ext, short))})"


def _lookup(table: str, url: str) -> str:
    """By the ending of the address without its query, else by the ending of all of it."""
    return (
        f"coalesce(try_element_at({table}, {extension(strip_query(url))}), try_element_at({table}, {extension(url)}))"
    )


def media_type(url: str) -> str:
    return _lookup(TYPE_OF, url)


def canonical_extension(url: str) -> str:
    return _lookup(CANONICAL_OF, url)


def stable_id(*parts: str) -> str:
    """An id that a rerun gives again, for what would otherwise be random."""
    return f"substring(sha2(concat_ws('|', {', '.join(f'cast({p} as string)' for p in parts)}), 256), 1, 32)"


def reference_kind(tag: str, version: int = 3) -> str:
    """``image`` for images and inputs, ``audiovideo`` for players except in the legacy version, else null."""
    players = "" if version == 2 else f" when {tag} in ('audio', 'video') then 'audiovideo'"
    return f"case when {tag} in ('img', 'input') then 'image'{players} end"


def local_href(book_id: str, kind: str, url: str, extension: str | None = None) -> str:
    """Address of a media file inside its book; null for an unknown type. The extension is that of the shipped list if none is given."""
    folder = f"if({kind} = 'image', 'images', 'audiovideo')"
    return f"concat({folder}, '/', {stable_id(book_id, kind, url)}, '.', {extension or canonical_extension(url)})"


def transfer_class(url: str, is_cover: str = "false", folder: str = MEDIA_FOLDER) -> str:
    """How a media file would be fetched: moved (it is in the job's own folder already), local, remote or skip."""
    return (
        f"case when startswith({url}, 'file://{folder}/') then 'moved' when startswith({url}, 'file://') then 'local'"
        f" when contains({url}, '://') then 'remote' when {is_cover} then 'local' else 'skip' end"
    )


def download_path(url: str, fmt_container: str, folder: str) -> str:
    return f"concat('file://', {text(folder)}, '/', substring(sha2({url}, 256), 1, 32), {fmt_container})"
